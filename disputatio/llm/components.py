"""Connected components of a link table, in rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputatio.llm.common import saved


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that has a link to another one.

    Every round hangs the larger neighbours of a node, then the smaller ones, on the smallest neighbour, until
    the links are stars around the smallest node of each component. Smallest neighbours are grouped with partial
    sums and joined back, so a hub with many links is never one group in one task. Each round is written to the
    shared folder; a lost executor repeats one round at most. Links that are null on a side or lead to
    themselves say nothing; an empty table gives an empty result.
    """
    edges = saved(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("v <> m").distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        lowest = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        large = both.select(F.col("v").alias("u"), F.col("m").alias("w")).join(lowest, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        hung = large.join(least, "v")
        small = hung.select("v", F.col("low").alias("m")).union(hung.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))).distinct()
        edges = saved(small, "links")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    nodes = edges.select(F.col("v").alias("node"), F.col("m").alias("component"))
    return nodes.union(edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
