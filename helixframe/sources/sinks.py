"""Where results go: one-row reports, rows, splits, corpora and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(summary: DataFrame, path: str) -> None:
    """A summary of few rows as JSON lines in one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Results a row at a time as Parquet, in folders by a column of few values if one is named."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_splits(records: DataFrame, path: str, split: str = "split", **construction: str) -> None:
    """(idx, and how the split was made) in a folder for each split; indices are sorted within and across files."""
    made = F.struct(*[F.lit(v).alias(k) for k, v in sorted(construction.items())]) if construction else F.lit(None).cast("string")
    rows = records.select(F.col(split).alias("split"), "idx", made.alias("construction"))
    # Ranges of (split, idx): a file's indices are sorted, and files follow one another.
    rows.repartitionByRange("split", "idx").sortWithinPartitions("split", "idx").write.mode("overwrite").partitionBy("split").parquet(path)


def write_corpus(records: DataFrame, path: str, split_path: str) -> None:
    """An augmented corpus and the split that holds all of it."""
    write_rows(records, path)
    write_splits(records.withColumn("split", F.lit("train_augmented")), split_path, type="augmented")


def append_history(epoch: DataFrame, history: DataFrame | None, path: str) -> DataFrame:
    """The history with the epochs added, written anew; a repeated epoch replaces the former one."""
    old = history.join(epoch.select("epoch"), "epoch", "left_anti") if history is not None else epoch.limit(0)
    out = old.unionByName(epoch, allowMissingColumns=True)
    out.coalesce(1).sortWithinPartitions("epoch").write.mode("overwrite").json(path)
    return out


def failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one): the second is written beside the first."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def manifest(expected: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """(key, present) for everything that is expected."""
    have = present.select(key).distinct().withColumn("present", F.lit(True))
    return expected.select(key).distinct().join(have, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def table_rows(summary: DataFrame, label: str, numbers: tuple[str, ...], names: dict[str, str] | None = None, pattern: str = "%+.4f") -> DataFrame:
    """One text line for each row: the label, by its printed name, and the numbers in one format, joined by ' & '."""
    named = F.coalesce(*([F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(label))] if names else []), F.col(label))
    cells = [F.when(F.col(n).isNull(), "--").otherwise(F.format_string(pattern, F.col(n).cast("double"))) for n in numbers]
    return summary.select(F.col(label), F.concat_ws(" & ", named, *cells).alias("line"))
