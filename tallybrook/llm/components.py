"""Connected components over a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_spread, settle


def components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """links: a, b (long).  Returns node, component (the smallest node it reaches) for every node of a link.

    Rounds of large-star and small-star steps; each replaces links by links to smaller nodes and keeps what is
    connected, until every node has one link, to its component's smallest.  Each round is written and
    read back, so that its lineage is one table, and the round before it is removed.  Minima are pre-aggregated, and
    a node with many links gets its minimum where the links are: no task gathers them.
    """
    spark = links.sparkSession
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "links-0")
    for k in range(1, most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, folder, f"least-{k}a").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = settle(large, folder, f"large-{k}")
        small = _with_least(large, folder, f"least-{k}b")
        small = small.select(F.explode(F.array(F.struct(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        now = settle(small.select("x.*").distinct(), folder, f"links-{k}")
        # The end: no link is new, and none is gone.
        done = now.count() == edges.count() and now.join(edges, ["u", "v"], "left_anti").limit(1).count() == 0
        discard(spark, folder, f"links-{k - 1}", f"least-{k}a", f"least-{k}b", f"large-{k}")
        edges = now
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"no end after {most_rounds} rounds")


def _with_least(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """u, v and m, the smallest v of u."""
    least = settle(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), folder, name)
    return join_spread(edges, least, "u", "n")
