"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

1. Every text is read once, into a narrow table (id, digest, code points) in the shared folder.
2. A Misra-Gries summary (``approx_top_k``, a mergeable frequent-items sketch) names the digests that may
   hold a thousandth of all rows or more: ``TOP`` at most, by the sketch's bound.
3. Their winners are computed exactly by an aggregate that combines map-side, and broadcast
   (``TOP`` rows at most), so that no copy of a frequent text is ever shuffled.
4. The winners of all other digests, each with under a thousandth of the rows, come from the same aggregate, and are joined by digest: an
   ordinary shuffle, whose large partitions AQE's skew join splits. No window takes the rows of a digest together.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Of equal texts the one
with most code points before normalisation stays, then the smallest id (a null id comes last). Of rows that
repeat both, one stays. Texts of any length are taken whole. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

#: Most digests that are treated as frequent, and counters of the sketch. A digest with a share of 1/SHARE or
#: more of the rows is always among them: the sketch's error is at most rows / (0.75 * COUNTERS).
TOP, COUNTERS, SHARE = 1024, 8192, 1000

#: Ids are broadcast up to this many (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 1 << 20

#: Deleted before texts are compared (a fixed value): space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ``BLANKS``; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def digest(text: Column) -> Column:
    """The SHA-256 of the normalised text."""
    return F.sha2(normalised(text).cast("binary"), 256)


def equal_classes(rows: DataFrame) -> DataFrame:
    """The class of each row of (id, key string not null, rank): plus keep_id, group_size and kept.

    The row with the largest rank, then the smallest id, is kept, exactly one per key. ``rows`` should be a stored table with a column ``row``, which
    tells rows apart that are equal otherwise; without it the rows are stored here.
    """
    if "row" not in rows.columns:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    frequent = materialize(
        rows.agg(F.expr(f"approx_top_k(key, {TOP}, {COUNTERS})").alias("top"))
        .select(F.inline("top"))
        .where(F.col("count") * SHARE >= max(total, SHARE))
        .select(F.col("item").alias("key")),
        "frequent",
    )
    best = F.min(F.struct((-F.col("rank")).alias("r"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row")))

    def winners(some: DataFrame) -> DataFrame:
        found = some.groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        return found.select("key", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")

    hot, cold = rows.join(F.broadcast(frequent), "key"), rows.join(F.broadcast(frequent), "key", "left_anti")
    decided = rows.join(F.broadcast(winners(hot)), "key").unionByName(cold.join(winners(cold), "key"))
    return decided.select("id", "key", "rank", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(F.col(ident).alias("id"), digest(F.col(text)).alias("key"), F.char_length(whole).alias("rank"), F.monotonically_increasing_id().alias("row")), "digests")
    return equal_classes(rows).select(F.col("id").alias(ident), "keep_id", "group_size", "kept", F.col("key").alias("text_sha256"))


def without(docs: DataFrame, decisions: DataFrame, ident: str = "doc_id", text: str | None = None) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (id, kept; one row per row of docs) keeps, with all their columns.

    The dropped ids are broadcast only up to ``BROADCAST_IDS`` of them. Where an id has both kept and
    dropped rows, as many of its rows stay as were kept: with ``text``, the column that the decisions' text_sha256 is of,
    as many of each normalised text, the longest first.
    """
    key = F.lit("") if text is None else F.col("text_sha256")
    decisions = materialize(decisions.select(F.col(ident).alias("_cf_id"), key.alias("_cf_key"), "kept"), "decisions")
    per_id = decisions.groupBy("_cf_id").agg(F.count_if("kept").alias("_cf_n"), F.count(F.lit(1)).alias("_cf_all"))
    dropped = materialize(per_id.where(F.col("_cf_n") < F.col("_cf_all")), "dropped")
    facts = dropped.agg(F.count(F.lit(1)), F.count_if(F.col("_cf_n") > 0)).first()
    gone = F.broadcast(dropped) if facts[0] <= BROADCAST_IDS else dropped
    on = F.col(ident).eqNullSafe(F.col("_cf_id"))
    stays = docs.join(gone, on, "left_anti")
    if facts[1]:
        # Of these few ids the rows are told apart by text; columns of docs stand in a struct, so no name can clash.
        parts = gone.where("_cf_n > 0").select("_cf_id")
        some = docs.join(parts, on).select(F.col(ident).alias("_cf_id"), (F.lit("") if text is None else digest(F.col(text))).alias("_cf_key"), (F.lit(0) if text is None else -F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("_cf_first"), F.struct(*docs.columns).alias("_cf_row"))
        counts = decisions.where("kept").groupBy(F.col("_cf_id").alias("_cf_own"), F.col("_cf_key").alias("_cf_text_key")).agg(F.count(F.lit(1)).alias("_cf_n"))
        some = some.join(counts, F.col("_cf_id").eqNullSafe(F.col("_cf_own")) & (F.col("_cf_key") == F.col("_cf_text_key")))
        place = F.row_number().over(Window.partitionBy("_cf_id", "_cf_key").orderBy("_cf_first", *[F.col("_cf_row")[c] for c in docs.columns if c != ident]))
        stays = stays.unionByName(some.withColumn("_cf_place", place).where("_cf_place <= _cf_n").select("_cf_row.*"))
    return stays
