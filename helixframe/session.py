"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helixframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of local Python workers; clusters ship it with ``--py-files``."""
    if spark.sparkContext.master.startswith("local["):
        env = spark.sparkContext.environment
        root = str(Path(__file__).resolve().parents[1])
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one machine, may leave it unset: a folder under the
    warehouse serves then.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return folder.rstrip("/")


#: Bytes of files that one task is dealt.
DEALT = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew where it is read from fewer files than there are cores, since a file may be one block; as it is otherwise.

    There are as many tasks as cores, and more as the files grow, so that none grows with them.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    places = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    size = sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in places)
    return df.repartition(max(cores, -(-size // DEALT)))


#: Seconds between two collections of the driver's garbage: short stages leave little to clean.
COLLECT_AFTER = 2.0
_collected: dict[str, float] = {}
#: Folders written and not yet discarded, with their sessions; what is left is deleted when the driver's Python ends.
_written: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; what is written there is deleted when the driver's Python ends, if not before."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder, and what has been registered for it."""
    _written.pop(folder, None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    for folder, spark in list(_written.items()):
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001  the session has ended before: its folder is the cluster's to clear
            pass


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor repeats at most one stage, and so
    that a frame used several times is computed once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # Lets Spark's cleaner drop the shuffle files of what is now written, which it does once the
    # driver has collected its garbage; until then they would fill the executors' disks.
    if time.monotonic() - _collected.get("at", -9.0) > COLLECT_AFTER:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected["at"] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames; call it once all that reads them is itself written."""
    for df in frames:
        if df._folder in _written:
            delete(df.sparkSession, df._folder)
