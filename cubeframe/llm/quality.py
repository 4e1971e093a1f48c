"""Quality classification by ordinal cumulative-link regression on graded ratings.

A document's features are its lower-cased words and its case-sensitive byte trigrams, hashed to ``1 << BITS`` buckets each, and the words that
repeat the one before them. A word counts by the logarithm of its number over the root of the number of words, so that few words can tell in a long text;
trigrams and repeats count by their frequency. One weight vector is shared by all grades, and ordered thresholds cut its score:
P(grade > k) = sigmoid(score - threshold k). All ratings count: by hash of the id four fifths (``FITTED``) are fitted, and the rest settle the
probability that selection asks for: ``CLEAN_LOSS`` of those with the top grade lie below it, exactly.

The fit has two steps. On the driver, Adam in batches finds where to start, from about ``RATED`` ratings and ``RATED_FEATURES`` features, whatever the
number and the length of the texts; of an id's ratings equal ones are one row with a weight, and so are equal texts of a grade. If that
was not all there is, the model is the minimum of the loss of all fitted ratings, weights decayed by ``DECAY``. The loss is convex in weights and thresholds, so it has one minimum, and the start
only shortens the way: L-BFGS, scaled by the loss's curvatures, goes on until ``NEAR`` it. The ratings' features are stored once, each of at most ``PASSES`` passes sums
over them in at most ``SUMS`` tasks, and a sum per task (of fixed size) comes to the driver. Terms are rounded to multiples of ``GRID``, so that sums
are the same in any order. Scoring is a lookup per word and trigram, with the weights broadcast (fixed size).

Defined cases: null and empty texts have no features and get the score 0 and the grades' base rates; ratings that are
null are ignored; without ratings, or with one grade only, every document is kept with the top grade; rows that repeat are
scored each; ratings that repeat count each; texts of any length are taken whole; columns that have the names of this operator's own are told apart by
position, and a result column may have the name of another; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import materialize, ship

BITS = 17
#: What the counts of words (log over root), and the frequencies of trigrams and of repeated words are multiplied by.
WORD_SCALE, TRIGRAM_SCALE, REPEAT_SCALE = 2.0, 8.0, 8.0
#: The share of the ratings that is fitted; all others settle the probability asked for.
FITTED = 0.8
#: Ratings that the fit starts from, on average, and as many more as make them ``FITTED`` of both: with fewer in all it starts from all that are fitted.
RATED, CALIBRATED = 12000, 4000
#: Features of the texts that the fit starts from, on average (6 bytes each; a text has at most twice ``1 << BITS`` and one).
RATED_FEATURES = 16 << 20
#: Passes over all fitted ratings at most, the tasks of a pass (2 MB each come to the driver, 4 MB with curvatures), and the steps that L-BFGS remembers (2 MB each).
PASSES, SUMS, MEMORY = 300, 16, 40
#: L-BFGS ends where the squared gradient over the curvatures, about twice what the loss is above its minimum, is at most this; curvatures are taken at the start and after these passes.
NEAR, CURVED = 1e-6, (20, 50, 100, 200)
#: The threshold below a lowest grade, and the width of another, of which there are no ratings.
LOWEST, NARROW = -30.0, 1e-3
#: What the terms of a pass are rounded to: sums below 2**21 are exact.
GRID = 2.0**-32
#: Ratings are broadcast up to this many (some 20 MB); beyond it the join with the texts shuffles.
BROADCAST_RATINGS = 1 << 18
#: Probabilities that come to the driver at once.
MOST_VALUES = 1 << 16
#: The share of the documents of the top grade that selection may lose.
CLEAN_LOSS = 0.01
STEPS, BATCH, RATE, DECAY = 400, 1500, 0.2, 1e-5


class Model(NamedTuple):
    weights: np.ndarray
    #: The thresholds between grades, ascending; none without two grades.
    cuts: np.ndarray
    #: The probability of the top grade that selection asks for.
    least: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets with the texts' bounds in them, trigram buckets with theirs, and which words repeat the one before."""
    found = _text.words(column)
    data, offsets = _text.flat(column)
    word = (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    d = data.astype(np.uint32)
    gram = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16) if len(d) > 2 else d[:0]
    gram = (gram * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
    # A trigram that runs over a text's end belongs to none: bounds stop two bytes before it.
    repeat = np.concatenate([[False], found.hashes[1:] == found.hashes[:-1]]) if len(word) else np.zeros(0, bool)
    first = found.bounds[:-1][np.diff(found.bounds) > 0]
    repeat[first] = False
    return word, found.bounds, gram, offsets, repeat


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of values[start:end], to the last bit the same whatever texts stand beside: one of them is the threshold."""
    out, some = np.zeros(len(starts)), np.flatnonzero(ends > starts)
    at = np.stack([starts[some], ends[some]], axis=1).ravel()
    if len(at):
        out[some] = np.add.reduceat(values, at[:-1] if at[-1] == len(values) else at)[::2]
    return out


def _word_counts(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct word buckets: the text's number, the bucket, and its value."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key, n = np.unique(text << BITS | word, return_counts=True)
    text = key >> BITS
    return text, key & ((1 << BITS) - 1), np.log1p(n) * (WORD_SCALE / np.sqrt(np.maximum(np.diff(bounds), 1)))[text]


def scores(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    word, bounds, gram, offsets, repeat = features(column)
    words, grams = np.diff(bounds), np.maximum(np.diff(offsets) - 2, 0)
    text, bucket, value = _word_counts(word, bounds)
    by_word = np.bincount(text, weights[bucket] * value, len(words))
    by_gram = _sums(weights[(1 << BITS) + gram], offsets[:-1], offsets[1:] - 2) * TRIGRAM_SCALE / np.maximum(grams, 1)
    by_repeat = _sums(repeat * weights[-1], bounds[:-1], bounds[1:]) * REPEAT_SCALE / np.maximum(words, 1)
    return by_word + by_gram + by_repeat


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, grade, weight, text): key, grade, weight, and the text's features as the bytes of 32-bit places and 16-bit values."""
    for whole in batches:
        for batch in _text.slices(whole, "text"):
            word, bounds, gram, offsets, repeat = features(batch.column(3))
            text, bucket, value = _word_counts(word, bounds)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            at, values = [], []
            for i in range(batch.num_rows):
                own = slice(cuts[i], cuts[i + 1])
                g, ng = np.unique(gram[offsets[i] : max(offsets[i], offsets[i + 1] - 2)], return_counts=True)
                again = repeat[bounds[i] : bounds[i + 1]].sum() * REPEAT_SCALE / max(bounds[i + 1] - bounds[i], 1)
                at.append(np.concatenate([bucket[own], g + (1 << BITS), [2 << BITS]]).astype("<i4").tobytes())
                values.append(np.concatenate([value[own], ng * (TRIGRAM_SCALE / max(ng.sum(), 1)), [again]]).astype("<f2").tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["key", "grade", "weight", "at", "value"])


def _row_slopes(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's likelihood, and the derivatives of its negative logarithm by the score and by each threshold."""
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - np.concatenate([[-40.0], cuts, [40.0]])[None, :], -40, 40)))
    own = np.arange(len(score))
    likely = np.maximum(above[own, grades] - above[own, grades + 1], 1e-9)
    slope = above * (1 - above)
    by_low, by_high = slope[own, grades] / likely, slope[own, grades + 1] / likely
    by_cut = np.array([np.where(grades == k + 1, by_low, 0) - np.where(grades == k, by_high, 0) for k in range(len(cuts))])
    return likely, by_high - by_low, by_cut


def _row_curvatures(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Each row's second derivative of the likelihood's negative logarithm by the score."""
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - np.concatenate([[-40.0], cuts, [40.0]])[None, :], -40, 40)))
    slope, own = above * (1 - above), np.arange(len(score))
    return slope[own, grades] + slope[own, grades + 1]


def slopes(score: np.ndarray, cuts: np.ndarray, grades: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The derivatives of the negative log-likelihood, to which row i adds by part[i], by the rows' scores and by the thresholds."""
    _, by_score, by_cut = _row_slopes(score, cuts, grades)
    return by_score * part, (by_cut * part).sum(axis=1)


def fit(grades: np.ndarray, bounds: np.ndarray, at: np.ndarray, values: np.ndarray, top: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood, in batches; row i has the features bounds[i] .. bounds[i + 1] and counts counts[i] times.

    Every bucket that a rated document has is fitted, however few have it; the others keep the weight 0.
    """
    n, size = len(grades), (2 << BITS) + 1
    counts = np.ones(n) if counts is None else counts.astype(float)
    share = np.clip([counts[grades > k].sum() / counts.sum() for k in range(top)], 1 / (counts.sum() + 1), 1 - 1 / (counts.sum() + 1))
    cuts = -np.log(share / (1 - share))
    # The thresholds are the first and the logarithms of the gaps, so they stay in order.
    theta = np.concatenate([np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second, mean = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    random = np.random.Generator(np.random.PCG64(12))
    for step in range(1, STEPS + 1):
        some = np.sort(random.permutation(n)[:BATCH])
        sizes = bounds[some + 1] - bounds[some]
        own_rows = np.repeat(np.arange(len(some)), sizes)
        take = np.arange(len(own_rows)) + np.repeat(bounds[some] - np.cumsum(sizes) + sizes, sizes)
        own_at, own_values, i, part = at[take], values[take].astype(np.float32), grades[some], counts[some] / counts[some].sum()
        weights, cuts = theta[:size], np.cumsum(np.concatenate([theta[size : size + 1], np.exp(theta[size + 1 :])]))
        score = np.bincount(own_rows, own_values * weights[own_at], len(some))
        by_score, by_cut = slopes(score, cuts, i, part)
        tail = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(own_at, own_values * by_score[own_rows], size) + DECAY * weights, tail[:1], tail[1:] * np.exp(theta[size + 1 :])])
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta - RATE * (1 - 0.9 * step / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        if step > STEPS // 2:
            mean += theta / (STEPS - STEPS // 2)
    return mean[:size], np.cumsum(np.concatenate([mean[size : size + 1], np.exp(mean[size + 1 :])]))


def _total(shared: Broadcast):
    """A task's sums over its rows of ``_sparse``: the count, the loss, its derivatives by the first threshold, the gaps and the weights, and, if asked for, its curvatures by them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, curved = shared.value
        count, loss, by_cuts, by_weights = 0, 0.0, np.zeros((1 + curved, len(cuts))), np.zeros((1 + curved, len(weights)))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_at = batch.column(3).to_pylist()
            sizes = np.array([len(x) // 4 for x in rows_at])
            at, values = np.frombuffer(b"".join(rows_at), "<i4").astype(np.intp), np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f2").astype(np.float64)
            grades, part = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            score = np.add.reduceat(weights[at] * values, np.cumsum(sizes) - sizes)
            likely, by_score, by_cut = _row_slopes(score, cuts, grades)
            by_cut = np.cumsum(by_cut[::-1], axis=0)[::-1]
            for i in range(1 + curved):
                row = by_score if i == 0 else _row_curvatures(score, cuts, grades)
                by_weights[i] += np.bincount(at, np.rint(values ** (i + 1) * np.repeat(row * part / GRID, sizes)), len(weights)) * GRID
                by_cuts[i] += (np.rint(by_cut ** (i + 1) * part / GRID) * GRID).sum(axis=1)
            loss -= (np.rint(np.log(likely) * part * 2**20) / 2**20).sum()
            count += int(part.sum())
        yield pa.record_batch([pa.array([np.concatenate([[count, loss], *by_weights, *by_cuts]).tobytes()], pa.binary())], names=["sums"])

    return work


def _objective(table: DataFrame, fixed: np.ndarray | None = None):
    """The function of weights and thresholds (the first, and the gaps) that ``fit`` makes small, over all rows of the stored table: its value and gradient, and its curvatures if asked for.

    ``fixed`` are the places of the thresholds whose derivative is taken as 0.
    """
    spark, size = table.sparkSession, (2 << BITS) + 1
    rows = table.coalesce(max(1, min(SUMS, spark.sparkContext.defaultParallelism)))

    def at(theta: np.ndarray, curved: bool = False) -> tuple:
        weights, cuts = theta[:size], np.cumsum(theta[size:])
        if not (np.diff(cuts) > 0).all():
            return np.inf, np.zeros_like(theta)
        shared = spark.sparkContext.broadcast((weights, cuts, int(curved)))
        parts = rows.mapInArrow(_text.frugal(_total(shared)), "sums binary").toArrow().column("sums")  # SUMS rows at most
        shared.destroy()
        total = np.sum([np.frombuffer(x.as_buffer(), "<f8") for x in parts], axis=0)
        by_weights, by_cuts = total[2 : 2 + (1 + curved) * size].reshape(-1, size) / total[0], total[2 + (1 + curved) * size :].reshape(-1, len(cuts)) / total[0]
        if fixed is not None:
            by_cuts[0, fixed] = 0
        out = total[1] / total[0] + DECAY / 2 * float(weights @ weights), np.concatenate([by_weights[0] + DECAY * weights, by_cuts[0]])
        return (*out, np.concatenate([by_weights[1] + DECAY, np.maximum(by_cuts[1], 1e-6)])) if curved else out

    return at


def descend(objective, theta: np.ndarray, passes: int) -> np.ndarray:
    """L-BFGS from theta, scaled by curvatures, with at most so many calls of the objective; the best point found."""
    value, gradient, curvature = objective(theta, True)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    used, curved = 1, [x for x in CURVED if x < passes - 1]
    while used < passes and float(gradient @ (gradient / curvature)) > NEAR:
        if curved and used >= curved[0]:
            curved.pop(0)
            curvature = objective(theta, True)[2]
            used += 1
        way, factors = -gradient, []
        for s, y, r in reversed(steps):
            factors.append(r * float(way @ s))
            way -= factors[-1] * y
        if steps:
            s, y, r = steps[-1]
            way /= curvature * (r * float(y @ (y / curvature)))
        else:
            way /= curvature * max(1.0, float(np.sqrt(gradient @ (gradient / curvature))))
        for (s, y, r), f in zip(steps, reversed(factors), strict=True):
            way += s * (f - r * float(way @ y))
        slope, length, found = float(gradient @ way), 1.0, False
        while used < passes and not found:
            other = theta + length * way
            other_value, other_gradient = objective(other)
            used += 1
            found = other_value <= value + 1e-4 * length * slope
            length /= 4
        if not found:
            break
        s, y = (other - theta).astype(np.float32), (other_gradient - gradient).astype(np.float32)
        if (product := float(s.astype(float) @ y)) > 0:
            steps = [*steps[1 - MEMORY :], (s, y, 1 / product)]
        theta, value, gradient = other, other_value, other_gradient
    return theta


def _shares(n: int) -> tuple[float, float]:
    """The shares of n ratings that the fit starts from, and of those beside them."""
    fitted = min(FITTED, RATED / max(n, 1))
    return fitted, min(1.0 - fitted, CALIBRATED / max(n, 1))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grades, counts, and the bounds, places and values of the features, by key, whatever the order of the rows."""
    order = np.lexsort([table.column("grade").to_numpy(), table.column("key").to_numpy()])
    rows_at, rows_values = table.column("at").to_pylist(), table.column("value").to_pylist()
    sizes = np.array([len(x) // 4 for x in rows_at])[order]
    values = np.frombuffer(b"".join(rows_values[i] for i in order), "<f2")
    rows_values.clear()
    at = np.frombuffer(b"".join(rows_at[i] for i in order), "<i4")
    return table.column("grade").to_numpy()[order], table.column("weight").to_numpy()[order], np.concatenate([[0], np.cumsum(sizes)]), at, values


def train(docs: DataFrame, ratings: DataFrame, ident: str = "doc_id", text: str = "text") -> Model:
    """The model from documents and ratings (id, grade 0, 1, ...)."""
    spark = docs.sparkSession
    ship(spark)
    ratings = ratings.select(F.col(ident).alias("_cf_id"), F.col("grade").cast("int").alias("_cf_grade")).where("_cf_id IS NOT NULL AND _cf_grade IS NOT NULL").groupBy("_cf_id", "_cf_grade").agg(F.count(F.lit(1)).alias("_cf_weight"))
    ratings = materialize(ratings, "ratings")
    n = ratings.count()
    start, _ = _shares(n)
    place = F.pmod(F.xxhash64(F.col("_cf_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    placed = ratings.withColumn("_cf_place", place)
    placed = F.broadcast(placed) if n <= BROADCAST_RATINGS else placed
    rated = docs.select(F.col(ident).alias("_cf_doc"), F.col(text).alias("text")).join(placed, F.col("_cf_doc") == F.col("_cf_id"))
    rated = materialize(rated.select(F.xxhash64("text").alias("key"), F.col("_cf_grade").alias("grade"), F.col("_cf_weight").alias("weight"), "text", F.col("_cf_place").alias("place")), "rated")
    some = rated.where(F.col("place") < start).groupBy("grade", "text").agg(F.sum("weight").alias("weight"), F.first("key").alias("key"))
    wanted = some.agg(F.sum(F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(2 << BITS)))).first()[0] or 0
    share = min(1.0, RATED_FEATURES / max(wanted, 1))
    types = "key long, grade int, weight long, at binary, value binary"
    some = some.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = some.select("key", "grade", "weight", "text").mapInArrow(_text.frugal(_sparse), types).toArrow()  # RATED rows and RATED_FEATURES features, about
    grades, counts, bounds, at, values = _arrays(table)
    del table
    fitted = rated.where(F.col("place") < FITTED)
    found = fitted.agg(F.collect_set("grade")).first()[0]
    if len(found) < 2:
        return Model(np.zeros((2 << BITS) + 1), np.zeros(0), 0.0)
    top = max(found)
    weights, cuts = fit(grades, bounds, at, values, top, counts) if len(grades) else (np.zeros((2 << BITS) + 1), np.arange(top, dtype=float))
    del at, values
    _text.release()
    if start < FITTED or share < 1:
        rows = materialize(fitted.select("key", "grade", "weight", "text").mapInArrow(_text.frugal(_sparse), types), "features")
        # Without ratings of a grade the loss has no minimum in its width, so the thresholds below the lowest grade, and the others' width, are set.
        fixed = np.setdiff1d(np.arange(top), found)
        cuts = np.concatenate([np.full(min(found), LOWEST), cuts[min(found) :]])
        gaps = np.maximum(np.diff(cuts), 0.1)
        gaps[fixed[fixed > 0] - 1] = NARROW
        theta = descend(_objective(rows, fixed), np.concatenate([weights, cuts[:1], gaps]), PASSES)
        weights, cuts = theta[: len(weights)], np.cumsum(theta[len(weights) :])
        _text.release()
    model = Model(weights, cuts, 0.5)
    others = graded(rated.where((F.col("place") >= FITTED) & (F.col("grade") == top)), model, ["weight"]).groupBy("p_top").agg(F.sum("weight").alias("weight"))
    return model._replace(least=_least(materialize(others, "probabilities"), CLEAN_LOSS, model.least))


def _least(table: DataFrame, share: float, default: float) -> float:
    """``_quantile`` of a stored table (p_top, weight), of which ``MOST_VALUES`` rows at most come to the driver."""
    total = table.agg(F.sum("weight")).first()[0]
    low, high, before = 0.0, 1.0, 0
    while (inside := table.where(F.col("p_top").between(low, high))).count() > MOST_VALUES:
        span = F.least(F.floor((F.col("p_top") - low) / (high - low) * 4096), F.lit(4095))
        run = before
        for r in sorted(inside.groupBy(span.alias("span")).agg(F.min("p_top").alias("low"), F.max("p_top").alias("high"), F.sum("weight").alias("weight")).collect()):
            if run <= share * total:
                low, high, before = r["low"], r["high"], run
            run += r["weight"]
    rows = inside.toArrow()
    return _quantile(rows.column("p_top").to_numpy(), rows.column("weight").to_numpy(), share, default, before, total)


def _quantile(values: np.ndarray, counts: np.ndarray, share: float, default: float, before: int = 0, total: int | None = None) -> float:
    """The largest value with at most ``share`` of all below it; of ``total`` there are ``before`` below the values."""
    if not len(values):
        return default
    order = np.argsort(values, kind="stable")
    below = before + np.cumsum(counts[order]) - counts[order]
    return float(values[order][below <= share * (counts.sum() if total is None else total)].max())


def _above(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The probabilities of grades above each threshold."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))


def _grade(model: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, _ = model.value
        for whole in batches:
            for batch in _text.slices(whole, whole.num_columns - 1):
                above = _above(scores(batch.column(batch.num_columns - 1), weights), cuts)
                tail = above[:, -1] if len(cuts) else np.ones(len(above))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(above.sum(axis=1)), pa.array(tail)], names=[*batch.schema.names[:-1], "_cf_expected", "_cf_top"])

    return work


def graded(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of docs, expected_grade, and p_top: the probability of the top grade."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*columns, F.col(text).alias("_cf_text"))
    types = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:-1]], "_cf_expected double", "_cf_top double"])
    return rows.mapInArrow(_text.frugal(_grade(spark.sparkContext.broadcast(model))), types).toDF(*columns, "expected_grade", "p_top")


def ratings_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 for low quality, 1 for good quality that is toxic, 2 for good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1), 2).alias("grade"))


def selected(docs: DataFrame, model: Model, least: float | None = None, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose probability of the top grade is at least ``least`` (what the model asks for, without it)."""
    spark, least = docs.sparkSession, model.least if least is None else least
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, _ = shared.value
        for whole in batches:
            for batch in _text.slices(whole, at):
                keep = _above(scores(batch.column(at), weights), cuts)[:, -1] >= least if len(cuts) else np.ones(batch.num_rows, bool)
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(_text.frugal(work), docs.schema)
