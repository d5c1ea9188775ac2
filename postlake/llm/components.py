"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay distributed; each step is a min per node and a join back, and its result is settled in shared
storage, until all edges lead straight to the least node of their component. A node of very many edges is
pre-aggregated before the shuffle and its join is left to skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, release, settle


def _settled(e: DataFrame) -> bool:
    """Whether every edge leads from a node of one edge to a node of no edge of its own."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not sums.where("out > 1 or (out > 0 and into > 0)").take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another one."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = narrowed(settle(e))
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, narrowed(settle(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
        release(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
