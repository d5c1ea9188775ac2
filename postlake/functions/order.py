"""Numbers within groups whose members may be a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group of very many members is numbered in.
RANGES = 256


def ordinal(rows: DataFrame, keys: list[str], order: str, into: str, span: int = 1 << 16) -> DataFrame:
    """The place (from 0) of each row among those of its keys, by a number that no two of them share.

    Groups of up to `span` members, nearly all, are numbered by one window. The members of larger ones are cut into
    RANGES ranges by quantiles of the number, counted by range and numbered within ranges, so that a group is never one
    task. Keys are not null.
    """
    within = Window.partitionBy(*keys).orderBy(order)
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > span).select(*keys)
    if not large.take(1):
        return rows.withColumn(into, (F.row_number().over(within) - 1).cast("long"))
    cuts = rows.join(large, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"))
    rows = rows.join(cuts, keys, "left")
    rows = rows.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(order))))).drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = rows.where("_range > 0").groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    first = rows.where("_range = 0").join(large, keys, "left_semi").groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = before.unionByName(first).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_before > 0").select(*keys, "_range", "_before")
    rows = rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1)
    return rows.join(before, [*keys, "_range"], "left").withColumn(into, (F.col(into) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_before")
