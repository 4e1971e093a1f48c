"""Connected components of a link table by alternating large-star and small-star.

Each pass is two joins of the links with per-node minima, which combine map-side before their shuffle, so a
node with very many links costs one partial row per task; the rows of such a node are split by AQE's skew join.
Every pass is written to the shared folder, which cuts the lineage. Links never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes but those that are their component's smallest; links: (a, b) long, loops ignored."""
    now = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # Stars, and so components, once every node has one link and no node at its lower end has links to lower ones.
        lower = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = now.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1).cast("long"))
        if not lower.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = materialize(_small_star(_large_star(now)), "links")
