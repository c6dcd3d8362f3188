"""Tables that are computed once for what they are computed from.

A stage is kept under its name and a fingerprint of its input files (path,
length, time of change) and parameters: a changed file, or another parameter,
leads to another folder and so to new work, and an unchanged one to none. Spark
marks a folder as whole when all tasks have committed; a folder without that mark
is what a run left that ended early, and is written anew.
"""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable
from dataclasses import dataclass

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import delete

#: Files whose times the driver looks up one by one; more are looked up by a job.
LISTED = 500


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]] | None:
    """(path, length, time) of the files at or below a path or pattern; None if they are many."""
    fs, place = _file_system(spark, path)
    found, waiting = [], list(fs.globStatus(place) or [])
    while waiting:
        status = waiting.pop()
        if status.isDirectory():
            waiting += list(fs.listStatus(status.getPath()))
        elif not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        if len(found) + len(waiting) > LISTED:
            return None
    return sorted(found)


def fingerprint(spark: SparkSession, paths: list[str], **parameters: object) -> str:
    """A name for the present contents of files and folders, by length and time of change, and for parameters."""
    told: list[object] = [json.dumps(parameters, sort_keys=True, default=str)]
    for path in paths:
        files = _listed(spark, path)
        if files is None:
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
            told.append((path, *rows.agg(F.count("*"), F.sum(one), F.sum(one * one % 1_000_003)).first()))
        else:
            told.append((path, files))
    return hashlib.sha256(repr(told).encode()).hexdigest()[:32]


@dataclass
class Store:
    """Stages below one folder, which all machines share."""

    spark: SparkSession
    folder: str

    def path(self, name: str, sources: list[str], **parameters: object) -> str:
        return f"{self.folder.rstrip('/')}/{name}/{fingerprint(self.spark, sources, **parameters)}"

    def done(self, path: str) -> bool:
        fs, place = _file_system(self.spark, f"{path}/_SUCCESS")
        return fs.exists(place)

    def stage(self, name: str, sources: list[str], build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
        """The table of this name for the present state of sources; build() makes it if it is not there whole."""
        path = self.path(name, sources, **parameters)
        if not self.done(path):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def forget(self, name: str, keep: str | None = None) -> None:
        """Delete the tables of a name but the one at ``keep``."""
        fs, place = _file_system(self.spark, f"{self.folder.rstrip('/')}/{name}")
        for status in fs.listStatus(place) if fs.exists(place) else []:
            path = status.getPath().toString()
            if keep is None or path.rstrip("/").rsplit("/", 1)[1] != keep.rstrip("/").rsplit("/", 1)[1]:
                delete(self.spark, path)


def remaining(work: DataFrame, results: DataFrame | None, keys: list[str]) -> DataFrame:
    """The work that has no result yet."""
    return work if results is None else work.join(results.select(*keys).distinct(), keys, "left_anti")


def resume(work: DataFrame, folder: str, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All results of work: those in the folder, and what build makes of the rest, added to the folder.

    A run that ended early has added nothing or all that it made; the next one
    goes on with what is missing.
    """
    spark = work.sparkSession
    fs, place = _file_system(spark, f"{folder}/_SUCCESS")
    before = spark.read.parquet(folder) if fs.exists(place) else None
    rest = remaining(work, before, keys)
    if before is None or not rest.isEmpty():
        build(rest).write.mode("append" if before is not None else "overwrite").parquet(folder)
    return spark.read.parquet(folder)


def provenance(spark: SparkSession, sources: list[str], **config: object) -> DataFrame:
    """One row of what a result was made by: parameters, versions, settings and the fingerprint of its sources."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
    row = {
        "config": json.dumps(config, sort_keys=True, default=str), "inputs": fingerprint(spark, sources), "spark_version": spark.version,
        "pyspark_version": pyspark.__version__, "python_version": platform.python_version(), "platform": platform.platform(),
        "application": spark.sparkContext.applicationId, "settings": {k: spark.conf.get(k, None) or "" for k in keys},
    }
    schema = ", ".join(f"{k} {'map<string,string>' if k == 'settings' else 'string'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).withColumn("at", F.current_timestamp())
