"""Positions and running sums within groups of any size.

A window partitioned by a group sorts the group in one task. Here rows are
sorted by ranges of (group, order), so that a large group spans many tasks, and
what stands before each range is added from one small row per range and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import materialize


def positions(df: DataFrame, by: list[str], order: list[str], out: str = "position") -> DataFrame:
    """df with the 0-based position of each row within its group; equal keys get neighbouring positions."""
    ranges = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranges = materialize(ranges.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "ranges")
    # A group's rows in a range are neighbours, so numbers within the range differ from positions by a constant.
    part = ranges.groupBy(*by, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.select(*by, "__p", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low")).alias("__shift"))
    return ranges.join(shift, [*by, "__p"]).withColumn(out, F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")


def tied_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the 1-based rank of value within its group, ties averaged; groups must not be null."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__t"))
    ranges = materialize(counts.repartitionByRange(*by, value).withColumn("__p", F.spark_partition_id()), "ranges")
    part = ranges.groupBy(*by, "__p").agg(F.sum("__t").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = part.select(*by, "__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*by, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranges.withColumn("__b", F.coalesce(F.sum("__t").over(inside), F.lit(0))).join(shift, [*by, "__p"])
    ranks = ranks.select(*by, value, "__t", (F.col("__shift") + F.col("__b") + (F.col("__t") + 1) / 2).alias(out))
    return df.join(ranks.withColumnRenamed("__t", f"{out}_ties"), [*by, value])
