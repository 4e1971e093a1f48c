"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to ``ORDERS`` characters, lower-cased, of whole texts) of each language by hash bucket. Documents
are the training rows that the caller gives; of a language with more than ``LANGUAGE_DOCS`` of them a sample by hash of the id
is counted, as large as that bound on average. The log-probability matrix (buckets by languages) is all that scoring needs; it is broadcast, and
its size is fixed by the buckets and the languages learned. Scoring looks up each n-gram's row and sums per document in numpy.

Defined cases: a null text or one without a letter is ``und`` with score 0; n-grams never seen have the smoothed probability; ties go
to the language first by code point; without training rows every document is ``und``; rows that repeat are scored each; an
empty table gives an empty result. Characters that lower-case to several stay as they are. Texts are taken whole: a long one in pieces that
overlap, whose sums add up, so memory doesn't grow with a text. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import ship

ORDERS = 3
BUCKET_BITS = 16
LANGUAGE_DOCS = 4000
UNKNOWN = "und"
#: Characters of a long text, and n-grams of a batch, that are worked on at once.
PIECE, STEP = 1 << 20, 1 << 16


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each code point, and which are letters (Unicode category L)."""
    every = [chr(i) for i in range(0x110000)]
    lower = np.arange(0x110000, dtype=np.uint32)
    for i, c in enumerate(every):
        low = c.lower()
        if low != c and len(low) == 1:
            lower[i] = ord(low)
    return lower, np.array([c.isalpha() for c in every])


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram at each character (the bucket after the last where it would leave the text); the texts' bounds; whether each has a letter."""
    lower, letter = _characters()
    data, offsets = _text.flat(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(data) else offsets
    has = np.concatenate([[0], np.cumsum(letter[points])])
    low = lower[points]
    out, value = [], np.zeros(len(points), np.uint64)
    end = np.repeat(starts[1:], np.diff(starts))
    for n in range(1, ORDERS + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = low[n - 1 :] if n <= len(points) else 0
        value = (value + shifted + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        bucket[np.arange(len(points)) + n > end] = 1 << BUCKET_BITS
        out.append(bucket)
    return out, starts, has[starts[1:]] > has[starts[:-1]]


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """``grams`` of the batch's texts; of a long text, which stands alone, piece by piece, each n-gram in one piece."""
    column = batch.column(at)
    if batch.num_rows != 1 or column.nbytes <= 4 * PIECE:
        yield grams(column)
        return
    text = column[0].as_py()
    for start in range(0, len(text), PIECE):
        buckets, starts, known = grams(pa.array([text[start : start + PIECE + ORDERS - 1]]))
        if start + PIECE < len(text):
            for bucket in buckets:
                bucket[PIECE:] = 1 << BUCKET_BITS
        yield buckets, starts, known


def _summed(matrix: np.ndarray, buckets: list[np.ndarray], starts: np.ndarray, total: np.ndarray) -> None:
    """Add the rows of the matrix of each text's n-grams to the text's row of the total."""
    texts = np.flatnonzero(np.diff(starts))
    for first in range(0, int(starts[-1]), STEP):
        last = min(first + STEP, int(starts[-1]))
        own = texts[(starts[texts] < last) & (starts[texts + 1] > first)]
        cuts = np.maximum(starts[own], first) - first
        for bucket in buckets:
            total[own] += np.add.reduceat(matrix[bucket[first:last]], cuts, axis=0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in _text.slices(whole, "text"):
            for buckets, starts, _ in _parts(batch, 1):
                for lang in set(batch.column(0).to_pylist()):
                    own = np.repeat(np.array([x == lang for x in batch.column(0).to_pylist()]), np.diff(starts))
                    total = totals.setdefault(lang, np.zeros((1 << BUCKET_BITS) + 1, np.int64))
                    for bucket in buckets:
                        total += np.bincount(bucket[own], minlength=len(total))
    for lang, total in totals.items():
        at = np.flatnonzero(total[:-1])
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])


def train(rows: DataFrame, smoothing: float = 0.5, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-probability matrix (buckets and a row of zeros, languages), from rows with a language."""
    ship(rows.sparkSession)
    rows = rows.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros(((1 << BUCKET_BITS) + 1, 0), np.float32)
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, LANGUAGE_DOCS / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30))
    counts = np.full((1 << BUCKET_BITS, len(languages)), smoothing)
    summed = sample.select("lang", "text").mapInArrow(_text.frugal(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most a cell each
    counts[summed.column("bucket").to_numpy(), np.searchsorted(languages, summed.column("lang").to_pylist())] += summed.column("n").to_numpy()
    prior = np.log([sizes[x] / sum(sizes.values()) for x in languages])
    matrix = np.log(counts / counts.sum(axis=0))
    return languages, np.vstack([matrix, np.zeros(len(languages))]).astype(np.float32), prior


def _predict(model: Broadcast):
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, matrix, prior = model.value
        names = np.array([*languages, UNKNOWN], object)
        for whole in batches:
            for batch in _text.slices(whole, "text"):
                known = np.zeros(batch.num_rows, bool)
                total = np.tile(prior, (batch.num_rows, 1))
                for buckets, starts, some in _parts(batch, 1):
                    known |= some & bool(languages)
                    if languages:
                        _summed(matrix, buckets, starts, total)
                best, score = np.full(len(known), len(languages)), np.zeros(len(known))
                if known.any():
                    total -= total.max(axis=1, keepdims=True)
                    likely = np.exp(total)
                    best = np.where(known, total.argmax(axis=1), len(languages))
                    score = np.where(known, likely.max(axis=1) / likely.sum(axis=1), 0.0)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)], schema=schema)

    return work, "id long, lang_pred string, score double"


def identify(docs: DataFrame, training: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, lang_pred (learned from ``training``, or ``und``), score (posterior probability)."""
    spark = docs.sparkSession
    ship(spark)
    model = train(training, ident=ident, text=text, lang=lang)
    work, types = _predict(spark.sparkContext.broadcast(model if len(model) == 3 else (*model, np.zeros(0))))
    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_text.frugal(work), types).withColumnRenamed("id", ident)


def fold(ident: Column, folds: int = 3) -> Column:
    """The fold of an id: crc32 of its decimal text, modulo ``folds``."""
    return F.crc32(ident.cast("string").cast("binary")) % folds
