"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def _smallest(links: DataFrame) -> DataFrame:
    """(u, v) rows with m, the smallest of u and its neighbours.

    The minimum is pre-aggregated and joined back, so a node with very many links
    is spread over tasks by the skew join instead of meeting in one window.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    found = _smallest(links)
    own = found.select("u", F.col("m").alias("v"))
    moved = found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(moved).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node.

    Large and small stars alternate until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Every round is written to the shared
    folder, so a lost executor costs a re-read.
    """
    now = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    while seen[0]:
        now = stage(_small_star(_large_star(now)))
        if (found := mark(now)) == seen:
            break
        seen = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
