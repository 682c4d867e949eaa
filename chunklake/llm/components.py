"""Connected components by alternating large-star and small-star steps, on a table of links.

Each step groups links by node with a minimum (partial sums run before the shuffle) and joins the minimum back to the links,
a join that Spark can split where a node has very many links. Every round is written to the shared folder. No component is
ever in one task or on the driver; the driver only reads whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.common import held, release, rows_in, written


def _star(links: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    return links.join(held(least, rows), "u")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of links (u, v), u <> v, in any order.

    Both columns must be orderable and free of nulls.
    """
    e = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _star(both, least, 2 * rows_in(e)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, is linked to the smallest of them
        large = written(large.where("u > v").distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, least, rows_in(large)).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, e = e, written(small.where("u > v").distinct(), "links-small")
        release(old, large)
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # stars only: u is a leaf, v its centre
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
