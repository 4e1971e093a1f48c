"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source's documents, laid end to end, make blocks of ``BLOCK_WORDS`` words (the last is shorter). The mix is a
row of output shards of slots, a block each:

1. The targets: weights over the sources, none above ``CAP`` times its size, the excess reshared by weight.
2. Each output shard draws its counts of blocks per source from a multinomial over what the targets still lack,
   so that chance never adds up: at the end every source has the whole number of slots nearest its target. The draws are in two levels: the driver
   draws the counts of runs of shards (``MOST_PLANNED`` numbers at most, beside a run's), and a run's task, from its own seed, those of its shards.
3. A source's j-th slot takes the block at place ``j % blocks`` of a pseudorandom permutation of its blocks, another
   permutation for each pass over them. So a block is used at most ``CAP`` times, and use is even.
4. Slots join the blocks by (source, index). A few rows make all slots, and a document many blocks, so Spark takes tables of either for small
   ones: their joins are told to shuffle (``SHUFFLED``), else they would be broadcast, by way of the driver.

A document's place among its source's words needs no sequential pass: sizes are summed per (source, hash bucket
of the id), the sums run up per source, and a window numbers the words within a bucket.

Defined cases: a null text has no words; a null source is a source of its own, last in order; ties in a bucket are broken by
size; documents without words are reported with 0 taken; texts of any length are taken whole; an empty table gives an empty result. Equal input gives equal
output. ``mix`` reads three columns, whatever the names of the others; ``mixed_documents`` keeps all columns, of which none may begin with ``_cf_``.
The sources (one row each) come to the driver and go to every task that draws, documents and blocks never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, ship
from .exact_dedup import BROADCAST_IDS

BLOCK_WORDS = 128
#: The weights of the sources by code point, repeating, and most uses of a word.
WEIGHTS, CAP = (5, 2, 1), 3
SHARD_SLOTS = 65536
LEAST_SHARDS = 8
#: Counts that the driver draws.
MOST_PLANNED = 1 << 20
#: Rows per bucket aimed at, and the range of the number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4096, 16, 65536
#: The hint of joins that nothing may be broadcast for.
SHUFFLED = "merge"
#: Words (a fixed pattern): runs of other characters than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """The words wanted of each source: shares of all sizes by weight, none above ``cap`` times its size."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    most, wanted = np.array(sizes, float) * cap, np.zeros(len(sizes))
    open_, left = np.ones(len(sizes), bool), float(sum(sizes))
    while open_.any():
        share = np.where(open_, weight, 0) * (left / weight[open_].sum())
        over = open_ & (share >= most)
        if not over.any():
            wanted[open_] = share[open_]
            break
        wanted[over] = most[over]
        left -= float(most[over].sum())
        open_ &= ~over
        if left <= 0:
            break
    return wanted.tolist()


def drawn(total: np.ndarray, rooms: list[int], seed: list[int]) -> Iterator[np.ndarray]:
    """For each room its counts per source, from multinomials over what is left of the total; the rooms add up to the total."""
    random, left = np.random.Generator(np.random.PCG64(seed)), total.copy()
    for room in rooms:
        own = np.zeros_like(left)
        while room:
            # What a source has left bounds what it gives; the rest of the room is drawn again.
            take = np.minimum(random.multinomial(room, left / left.sum()), left)
            own += take
            left -= take
            room -= int(take.sum())
        yield own


def _rooms(slots: int, shards: int) -> list[int]:
    """The slots of each shard: equal ones, the last ones less."""
    most = -(-slots // shards) if slots else 0
    return [max(0, min(most, slots - i * most)) for i in range(shards)]


def slot_totals(sizes: list[int], wanted: list[float], block_words: int = BLOCK_WORDS, cap: int = CAP) -> tuple[list[int], np.ndarray]:
    """The number of blocks of each source, and the number of slots that it gets."""
    blocks = [-(-s // block_words) for s in sizes]
    return blocks, np.array([min(cap * b, round(w * b / s)) if s else 0 for s, w, b in zip(sizes, wanted, blocks, strict=True)], np.int64)


def planned(total: np.ndarray, seed: int) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Runs of output shards: the first shard, the slots of each, the uses of each source before the run, and in it."""
    slots = int(total.sum())
    shards = max(LEAST_SHARDS, -(-slots // SHARD_SLOTS))
    per_run = -(-shards // max(1, min(shards, MOST_PLANNED // max(1, len(total)))))
    rooms = _rooms(slots, shards)
    runs = [rooms[i : i + per_run] for i in range(0, shards, per_run)]
    before = np.zeros_like(total)
    for number, own in enumerate(drawn(total, [sum(r) for r in runs], [seed])):
        yield number * per_run, runs[number], before.copy(), own
        before += own


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), keyed: a Feistel network on the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64) for r in range(1, 5)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) & mask
        return left << shift | right

    out = once(x.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _slots(plan: Broadcast, seed: int):
    """The slots of runs of shards (first shard, rooms, uses before, uses)."""
    schema = pa.schema([("number", pa.int32()), ("block", pa.int64()), ("out_shard", pa.int32()), ("slot", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = plan.value
        for batch in batches:
            for run, rooms, before, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                firsts, total = np.frombuffer(before, "<i8").copy(), np.frombuffer(total, "<i8")
                for shard, counts in enumerate(drawn(total, np.frombuffer(rooms, "<i8").tolist(), [seed, run]), run):
                    slot = 0
                    for number in np.flatnonzero(counts).tolist():
                        first, count = int(firsts[number]), int(counts[number])
                        for start in range(first, first + count, 1 << 16):
                            j = np.arange(start, min(first + count, start + (1 << 16)))
                            turns, at = np.divmod(j, blocks[number])
                            index = np.empty(len(j), np.int64)
                            for turn in np.unique(turns):
                                index[turns == turn] = permuted(at[turns == turn], blocks[number], seed + number * 1009 + int(turn) * 9176263)
                            yield pa.record_batch([pa.array(np.full(len(j), number, np.int32)), pa.array(index), pa.array(np.full(len(j), shard, np.int32)), pa.array(slot + j - first)], schema=schema)
                        slot += count
                    firsts += counts

    return work, "number int, block long, out_shard int, slot long"


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = 7, ident: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables.

    documents: id, number (of the source), size, source_size, target, first (place among the source's words);
    pieces: id, number, first, size, block, start (word in the document), words: what of each block is whose;
    slots: out_shard, slot, number, block: the mix, a block per slot.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(ident).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in per_source]
    wanted = targets(sizes, weights, cap)
    sources = spark.createDataFrame([(r["source"], i, r["size"], w) for i, (r, w) in enumerate(zip(per_source, wanted, strict=True))], "_cf_source string, number int, source_size long, target double")
    sources = F.broadcast(sources) if len(per_source) <= BROADCAST_IDS else sources
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS)))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_cf_source"))).drop("source", "_cf_source").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("number", "bucket").agg(F.sum("size").alias("own")).withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    inside = Window.partitionBy("number", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["number", "bucket"])
    documents = materialize(placed.select("id", "number", "size", "source_size", "target", (F.col("start") + F.col("within")).alias("first")), "documents")
    last = F.expr(f"(first + size - 1) div {block_words}")
    cuts = documents.where("size > 0").select("id", "number", "first", "size", F.explode(F.sequence(F.expr(f"first div {block_words}"), last)).alias("block"))
    start = F.greatest(F.col("block") * block_words - F.col("first"), F.lit(0))
    pieces = cuts.withColumn("start", start).withColumn("words", F.least((F.col("block") + 1) * block_words - F.col("first"), F.col("size")) - F.col("start"))
    blocks, total = slot_totals(sizes, wanted, block_words, cap)
    runs = [(first, np.array(rooms, "<i8").tobytes(), before.astype("<i8").tobytes(), own.astype("<i8").tobytes()) for first, rooms, before, own in planned(total, seed)]
    work, types = _slots(spark.sparkContext.broadcast(blocks), seed)
    tasks = max(1, min(len(runs), int(total.sum()) // SHARD_SLOTS + 1))
    table = spark.createDataFrame(runs, "run int, rooms binary, before binary, total binary").repartition(tasks).mapInArrow(_text.frugal(work), types)
    return documents, pieces, table


def _used(documents: DataFrame, pieces: DataFrame, slots: DataFrame) -> DataFrame:
    uses = slots.groupBy("number", "block").agg(F.count(F.lit(1)).alias("uses"))
    return pieces.hint(SHUFFLED).join(uses, ["number", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix(docs: DataFrame, ident: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, size, source_size, target and taken (words that the mix takes, repeats counted)."""
    documents, pieces, slots = mixture(docs, ident=ident, **options)
    used = _used(documents, pieces, slots).groupBy("id", "number", "first").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.max("size").alias("size"))
    facts = documents.select("number", "source_size", "target").distinct()
    some = used.join(F.broadcast(facts), "number").select("id", "size", "source_size", "target", "taken")
    none = documents.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).withColumnRenamed("id", ident)


def _rebuild(columns: list[str], ident: str, text: str):
    import re

    word = re.compile(WORD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (whole, takes) in enumerate(zip(batch.column(batch.schema.get_field_index(text)).to_pylist(), batch.column(batch.schema.get_field_index("_cf_takes")).to_pylist(), strict=True)):
                spans = [m.span() for m in word.finditer(whole or "")]
                takes.sort(key=lambda t: t["start"])
                for turn in range(max(t["uses"] for t in takes)):
                    parts: list[list[int]] = []
                    for t in takes:
                        if t["uses"] > turn and t["start"] < len(spans):
                            if parts and parts[-1][1] == t["start"]:
                                parts[-1][1] += t["words"]
                            else:
                                parts.append([t["start"], t["start"] + t["words"]])
                    if parts:
                        rows.append(i)
                        texts.append("\n".join(whole[spans[a][0] : spans[min(b, len(spans)) - 1][1]] for a, b in parts))
            kept = batch.take(pa.array(rows, pa.int64()))
            out = {c: kept.column(kept.schema.get_field_index(c)) for c in columns}
            out[text] = pa.array(texts, batch.schema.field(text).type)
            yield pa.record_batch(list(out.values()), names=list(out))

    return work


def mixed_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each use that a document's blocks have, a row with the text of these blocks.

    A document whose blocks the mix uses once stays as it is (from its first word to its last), unused words go, and words used
    again are in further rows with the same id. Where only some columns follow from the text, as ``n_chars``, the caller sets them.
    """
    documents, pieces, slots = mixture(docs, ident=ident, text=text, source=source, **options)
    takes = _used(documents, pieces, slots).where("uses > 0").groupBy("id", "number", "first").agg(F.collect_list(F.struct("start", "words", "uses")).alias("_cf_takes"))
    # Ids that repeat (or are null) take a way of their own, so that all others' texts are shuffled once.
    repeated = materialize(documents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select(F.col("id").alias("_cf_id")), "repeated")
    n = repeated.count()
    columns = [*docs.columns, "_cf_takes"]
    if not n:
        joined = docs.join(takes.select(F.col("id").alias("_cf_id"), "_cf_takes").hint(SHUFFLED), F.col(ident) == F.col("_cf_id")).select(columns)
    else:
        several = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
        same = F.col(ident).eqNullSafe(F.col("_cf_id"))
        own = takes.select(F.col("id").alias("_cf_id"), "number", "first", "_cf_takes")
        once = docs.join(several, same, "left_anti").join(own.hint(SHUFFLED), F.col(ident) == F.col("_cf_id")).select(columns)
        placed = own.withColumn("_cf_place", F.row_number().over(Window.partitionBy("_cf_id").orderBy("number", "first"))).withColumnRenamed("_cf_place", "_cf_own")
        more = docs.join(several, same, "left_semi").withColumn("_cf_place", F.row_number().over(Window.partitionBy(ident).orderBy(F.col(source).asc_nulls_last(), F.regexp_count(F.col(text), F.lit(WORD)))))
        joined = once.unionByName(more.join(placed.hint(SHUFFLED), same & (F.col("_cf_place") == F.col("_cf_own"))).select(columns))
    return joined.mapInArrow(_text.frugal(_rebuild(docs.columns, ident, text)), docs.schema)
