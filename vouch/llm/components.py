"""Connected components of a link table, by alternating large-star and small-star steps.

Each step groups by node with partial aggregation and joins the minimum back; no neighbourhood is ever gathered in one
task, and as the minima are written first, the join can split the links of a hot node. Every round is written to the
shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of u goes to the least of u and its neighbours."""
    both = _both_ways(links)
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows=n)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """u and its smaller neighbours go to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least", rows=n)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _only_stars(links: DataFrame) -> bool:
    """Whether no node is both a leaf (u) and a centre (v), and each leaf has one centre; then nothing moves any more."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least")).filter("leaves > least").isEmpty()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and component (its least node) for every node of links (u, v); nodes without links don't appear. rows: of links, if known."""
    now = written(links.select("u", "v").filter("u != v").distinct(), "links", rows=rows)
    while True:
        n = now.count()
        now = written(_small_star(_large_star(now, n), n), "links", rows=n)
        if _only_stars(now):
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
