"""Near-duplicate documents: many universal hash minima, banding, signature and set verification, components.

A document is the set of its distinct word shingles; two documents are linked when 100 times the size of the
intersection reaches ``percent`` times that of the union.

1. One pass over the texts gives each document the digest of its set and ``BANDS`` band keys of ``ROWS`` minima
   each. A pair at similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.99999 at 0.85, 0.999 at 0.8.
2. Documents with equal sets form classes (heavy-hitter split of the exact deduplication); only the smallest id
   of a class goes on, so copies never meet in a bucket.
3. In each bucket (a band key of two classes or more) every member is compared with the smallest id: the pair must pass the estimate from its
   signatures (four standard errors below the threshold pass) and then the exact test on both full sets. Links are united by
   large-star and small-star. A group of copies is connected here with a pair per member.
4. Buckets whose members still lie in several components are resolved exactly: their members, with signatures and sets, meet in blocks (a
   bucket of more than ``BLOCK`` members or ``BLOCK_BYTES`` of sets in pairs of blocks, so no task takes a whole bucket). A block tests the pairs of
   different components, each pair in the first band it shares only, and emits a link only where it connects two components: at most
   one per member, never the pairs. Links are united again.

Defined cases: null or empty texts have an empty set and link with nothing; with fewer words than a shingle has,
the whole sequence is the only shingle. Ids must be unique integers for links to be told apart; rows that repeat an
id are reported once each with the same component, and each is kept if its id is. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, ship
from .components import components
from .exact_dedup import BROADCAST_IDS, equal_classes

BANDS, ROWS = 24, 6
BLOCK, BLOCK_BYTES = 1024, 8 << 20


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the universal family a * x + b modulo 2**32 (a odd) on mixed 32-bit values."""
    random = np.random.Generator(np.random.PCG64(9001))
    n = BANDS * ROWS
    return random.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over the set (not empty)."""
    a, b = _hash_family()
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(x), 4096):
        np.minimum(low, (a[:, None] * x[None, start : start + 4096] + b[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, made from its number and its minima."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _sketches(width: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.string()), ("rank", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.slices(whole, "text"):
                keys, sizes, bands = [], [], []
                for s in _text.shingle_sets(_text.words(batch.column(1)), width):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    bands.append(band_keys(signature(s)) if len(s) else None)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return work, "id long, key string, rank long, bands array<long>"


def _evidence(width: int):
    schema = pa.schema([("id", pa.int64()), ("low", pa.binary()), ("shingles", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text.slices(whole, "text"):
                sets = list(_text.shingle_sets(_text.words(batch.column(1)), width))
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return work, "id long, low binary, shingles binary"


def _least_agreement(percent: int) -> int:
    """Minima that must agree: four standard errors below the threshold."""
    n, s = BANDS * ROWS, percent / 100
    return math.floor(n * s - 4 * math.sqrt(n * s * (1 - s)))


def _verify(percent: int):
    least = _least_agreement(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, low_a, low_b, set_a, set_b = (batch.column(i) for i in range(6))
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(low_a[i].as_buffer(), np.uint32), np.frombuffer(low_b[i].as_buffer(), np.uint32)
                if np.count_nonzero(x == y) < least:
                    continue
                s, t = np.frombuffer(set_a[i].as_buffer(), np.uint64), np.frombuffer(set_b[i].as_buffer(), np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                place = np.searchsorted(s, t)
                place[place == len(s)] = 0
                common = int(np.count_nonzero(s[place] == t))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.record_batch([a.take(keep), b.take(keep)], schema=schema)

    return work, "a long, b long"


def _resolve(percent: int):
    """Of one pair of blocks of a bucket: the links that connect components."""
    least = _least_agreement(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        band = table.column("band")[0].as_py()
        part = table.column("comp").to_numpy().copy()
        low = np.frombuffer(b"".join(x.as_py() for x in table.column("low")), np.uint32).reshape(len(ids), -1)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found: list[tuple[int, int]] = []
        for i in left:
            others = right[part[right] != part[i]]
            if side[i] == -1:
                others = others[others > i]
            others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
            if not len(others):
                continue
            same = low[others] == low[i]
            others = others[(same.sum(axis=1) >= least) & (same.reshape(len(others), BANDS, ROWS).all(axis=2).argmax(axis=1) == band)]
            for start in range(0, len(others), 64):
                some = others[start : start + 64]
                some = some[part[some] != part[i]]
                if not len(some):
                    continue
                joined = np.concatenate([sets[j] for j in some])
                place = np.searchsorted(sets[i], joined)
                place[place == sizes[i]] = 0
                ends = np.cumsum(sizes[some])
                hits = np.concatenate([[0], np.cumsum(sets[i][place] == joined)])
                common = hits[ends] - hits[ends - sizes[some]]
                for j in some[100 * common >= percent * (sizes[some] + sizes[i] - common)]:
                    if part[j] != part[i]:
                        found.append((int(ids[i]), int(ids[j])))
                        part[part == part[j]] = part[i]
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return work, "a long, b long"


def _links(docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, component) of the class representatives in ``sketches`` (id, rank, bands), by verified links; None without links."""
    keys = sketches.select("id", "rank", F.posexplode("bands").alias("band", "bucket"))
    shared = keys.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("members"), (F.sum("rank") * 8).alias("bytes")).where("members > 1")
    buckets = materialize(keys.join(shared, "bucket"), "buckets")
    wanted = materialize(buckets.select("id").distinct(), "candidates")
    n = wanted.count()
    if not n:
        return None
    few = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    work, types = _evidence(width)
    evidence = materialize(docs.join(few, "id", "left_semi").select("id", "text").mapInArrow(_text.frugal(work), types).dropDuplicates(["id"]), "evidence")
    pairs = buckets.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    one = evidence.select(F.col("id").alias("a"), F.col("low").alias("low_a"), F.col("shingles").alias("set_a"))
    two = evidence.select(F.col("id").alias("b"), F.col("low").alias("low_b"), F.col("shingles").alias("set_b"))
    check, kind = _verify(percent)
    found = materialize(pairs.join(two, "b").join(one, "a").select("a", "b", "low_a", "low_b", "set_a", "set_b").mapInArrow(_text.frugal(check), kind), "verified")
    linked = components(found)
    labelled = buckets.join(linked.withColumnsRenamed({"node": "id", "component": "comp"}), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = labelled.groupBy("bucket").agg(F.min("comp").alias("low_comp"), F.max("comp").alias("high_comp")).where("low_comp != high_comp").select("bucket")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    places = F.transform(other, lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j"), F.when(o == F.col("own"), -1).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    dealt = labelled.join(several, "bucket", "left_semi").withColumn("blocks", blocks).withColumn("own", own).select("bucket", "band", "id", "comp", F.explode(places).alias("at"))
    resolve, kind = _resolve(percent)
    more = dealt.select("bucket", "band", "id", "comp", "at.*").join(evidence, "id").groupBy("bucket", "i", "j").applyInArrow(resolve, kind)
    more = materialize(more, "resolved")
    return components(found.unionByName(more)) if more.head(1) else linked


def minhash_dedup(docs: DataFrame, width: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    work, types = _sketches(width)
    sketches = materialize(texts.mapInArrow(_text.frugal(work), types), "sketches")
    classes = materialize(equal_classes(sketches.where("key IS NOT NULL").select("id", "key", "rank")).select("id", F.col("rank").alias("n_shingles"), F.col("keep_id").alias("class_id")), "classes")
    first = classes.where("id = class_id").select("id").distinct()
    linked = _links(texts, sketches.where("key IS NOT NULL").join(first, "id", "left_semi").dropDuplicates(["id"]), width, percent)
    if linked is None:
        placed = classes.withColumn("component_id", F.col("class_id"))
    else:
        placed = classes.join(linked.withColumnsRenamed({"node": "class_id", "component": "component_id"}), "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    alone = sketches.where("key IS NULL").select("id", F.col("rank").alias("n_shingles"), F.col("id").alias("component_id"))
    every = placed.select("id", "n_shingles", "component_id").unionByName(alone)
    return every.select(F.col("id").alias(ident), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
