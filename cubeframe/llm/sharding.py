"""Shards along a Hilbert curve over metadata dimensions, in DataFrame operations only.

Each row's dimensions are quantised to ``BITS`` bits (categories by hash, sizes by logarithm); the cells are
ordered by their index on the Hilbert curve, and equal runs of rows along the curve become the shards. Files
written per shard then cover small boxes in all dimensions at once, so min/max statistics prune by any of them.

Exact ranks need no global sort: rows are counted per (cell, bucket), where a cell with many rows has as many
hash buckets as keep a bucket near ``rows / MOST_BUCKETS`` rows; the counts (at most 2 * MOST_BUCKETS plus the
number of cells, whatever the data) are summed up in curve order and broadcast; within a bucket rows are
numbered by a window. A hot cell is thus spread over many tasks.

Defined cases: a null category is a category of its own, a null text has size 8 (no bytes); ties are broken by
the text's checksum, then id; rows that repeat get different slots; with fewer rows than shards the last shards
stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

BITS = 5
MOST_BUCKETS = 65536
LEAST_BUCKET_ROWS = 1024


def category_dimension(column: Column, bits: int = BITS) -> Column:
    """A category's place on its axis: equal values share it, null has its own value to hash."""
    return F.pmod(F.xxhash64(F.coalesce(column.cast("string"), F.lit("\0null"))), F.lit(1 << bits)).cast("int")


def size_dimension(column: Column, bits: int = BITS) -> Column:
    """Two steps per doubling of the size."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double")) * 2), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a point with ``bits`` bits in each axis.

    Per bit from the highest and per axis, the lower bits of the point are reflected or swapped with the first
    axis; then the Gray code is undone, and the bits are interleaved.
    """
    n = len(axes)
    point = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << level).cast("long").alias("q")) for level in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        own, first, p = F.get(x, step["i"]), F.get(x, F.lit(0)), step["q"] - 1
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        return F.transform(
            x,
            lambda v, j: F.when(own.bitwiseAND(step["q"]) != 0, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))
            .when((step["i"] != 0) & ((j == 0) | (j == step["i"])), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    point = F.aggregate(steps, point, turn)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), point, lambda x, i: F.transform(x, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))) if n > 1 else point
    undo = F.aggregate(
        F.array(*[F.lit(1 << level).cast("long") for level in range(bits - 1, 0, -1)]),
        F.struct(F.lit(0).cast("long").alias("t"), gray.alias("x")),
        lambda s, q: F.struct(F.when(F.get(s["x"], F.lit(n - 1)).bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t"), s["x"].alias("x")),
        lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(s["t"])),
    )
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(level).alias("b")) for level in range(bits - 1, -1, -1) for i in range(n)])
    return F.aggregate(
        order,
        F.struct(F.lit(0).cast("long").alias("h"), undo.alias("x")),
        lambda s, o: F.struct((s["h"] * 2 + F.getbit(F.get(s["x"], o["i"]), o["b"]).cast("long")).alias("h"), s["x"].alias("x")),
        lambda s: s["h"],
    )


def shards(rows: DataFrame, axes: list[str], tie: list[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """``rows`` (a stored table) plus shard int and slot long: equal runs along the curve through ``axes``.

    Shard sizes differ by one row at most, the larger ones first. ``tie`` orders the rows of a bucket.
    """
    cells = materialize(rows.groupBy(*axes).agg(F.count(F.lit(1)).alias("_cf_rows")).withColumn("_cf_curve", hilbert_index([F.col(a) for a in axes], bits)), "cells")
    total = cells.agg(F.coalesce(F.sum("_cf_rows"), F.lit(0))).first()[0]
    target = max(LEAST_BUCKET_ROWS, -(-total // MOST_BUCKETS))
    buckets = cells.select(*axes, "_cf_curve", F.ceil(F.col("_cf_rows") / target).alias("_cf_buckets"))
    placed = rows.join(F.broadcast(buckets), axes).withColumn("_cf_bucket", F.pmod(F.xxhash64(*tie), F.col("_cf_buckets")))
    counts = placed.groupBy("_cf_curve", "_cf_bucket").agg(F.count(F.lit(1)).alias("_cf_n"))
    along = Window.orderBy("_cf_curve", "_cf_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("_cf_start", F.coalesce(F.sum("_cf_n").over(along), F.lit(0))).drop("_cf_n"), "starts")
    within = Window.partitionBy("_cf_curve", "_cf_bucket").orderBy(*tie)
    small, larger = divmod(total, n_shards)
    rank, edge = F.col("_cf_rank"), larger * (small + 1)
    return (
        placed.join(F.broadcast(starts), ["_cf_curve", "_cf_bucket"])
        .withColumn("_cf_rank", F.col("_cf_start") + F.row_number().over(within) - 1)
        .withColumn("shard", F.when(rank < edge, F.expr(f"_cf_rank div {small + 1}")).otherwise(larger + F.expr(f"(_cf_rank - {edge}) div {max(small, 1)}")).cast("int"))
        .withColumn("slot", F.when(rank < edge, rank % (small + 1)).otherwise((rank - edge) % max(small, 1)))
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, ident: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: id, size, text_crc32, law ``rows``, shard, slot and a null grown_shard.

    The dimensions are the ``categories`` and the size (UTF-8 bytes of the text plus 8).
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    rows = materialize(
        docs.select(
            F.col(ident).alias("id"),
            size.alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            *[category_dimension(F.col(c)).alias(f"_cf_axis{i}") for i, c in enumerate(categories)],
            size_dimension(size).alias(f"_cf_axis{len(categories)}"),
        ),
        "metadata",
    )
    placed = shards(rows, [f"_cf_axis{i}" for i in range(len(categories) + 1)], ["text_crc32", "id"], n_shards)
    return placed.select(F.col("id").alias(ident), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
