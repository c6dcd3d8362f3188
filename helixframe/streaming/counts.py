"""Codon counts of a stream of records, each counted exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.functions import codons as C
from helixframe.sources.corpus import optional

KEYS = ["gene_name", "codon"]


def batch_counts(records: DataFrame) -> DataFrame:
    codons = records.select("gene_name", F.explode(C.chunked(F.col("sequence"))).alias("codon"))
    return codons.groupBy(*KEYS).agg(F.count("*").alias("n"))


def follow(records: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Count the codons of a stream into the folder.

    A batch writes to a place of its own, which a repetition after a failure
    overwrites with the same rows: however often a batch runs, it counts once.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return records.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(gene_name, codon, n) of all batches so far."""
    schema = "gene_name string, codon string, n long, batch long"
    rows = optional(lambda p: spark.read.schema(schema).parquet(p), folder)
    rows = rows if rows is not None else spark.createDataFrame([], schema)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))
