"""Batches of sequences of like lengths whose padded size stays within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ranking import positions


def cut(lengths: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """(length, batch, room, size) for each (length, count), shortest first.

    Rows go into the open batch while it holds them padded to their length; of a
    length's rows the first ``room`` go to ``batch``, the others to the batches
    after it, ``size`` to each. This is the cut of a walk over the rows, done for
    all rows of a length at once.
    """
    out, batch, held = [], 0, 0
    for length, count in lengths:
        size = max(1, budget // max(length, 1))  # a row beyond the budget has a batch of its own
        room = max(0, size - held) if held else size
        out.append((length, batch, room, size))
        if count <= room:
            held += count
        else:
            more = count - room
            batch += -(-more // size)
            held = (more - 1) % size + 1
    return out


def padded_batches(records: DataFrame, length: str, budget: int, order: list[str], out: str = "batch") -> DataFrame:
    """records with their batch, numbered by length: rows times the longest row of a batch are within the budget.

    Rows of one length follow ``order``. Only the different lengths, with how
    many rows have each, go through a loop on the driver: as many as the longest
    sequence has letters at most. Rows are numbered by ranges, not in one task.
    """
    spark = records.sparkSession
    counts = records.groupBy(F.col(length).cast("long").alias("__l")).count().where("__l is not null").orderBy("__l").collect()
    plan = spark.createDataFrame(cut([(r["__l"], r["count"]) for r in counts], budget), "__l long, __b long, __room long, __size long")
    placed = positions(records.withColumn("__l", F.col(length).cast("long")), ["__l"], order, "__i")
    behind = F.col("__i") - F.col("__room")
    number = F.when(behind < 0, F.col("__b")).otherwise(F.col("__b") + 1 + F.floor(behind / F.col("__size")))
    return placed.join(plan, "__l").withColumn(out, number.cast("long")).drop("__l", "__i", "__b", "__room", "__size")
