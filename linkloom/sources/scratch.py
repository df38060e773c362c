"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset.

    Executors on other machines could not read a folder of the driver's, so without that setting only a local master will do.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if not at:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="linkloom-")
            atexit.register(_forget, at[len("file://") :])
    return at.rstrip("/")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Folders that this session has made, and the threads that made them.
MADE: list[str] = []
MAKERS: dict[str, int] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    MAKERS[path] = threading.get_ident()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all folders that this session has made, once no result is read any more. Works in any store that Spark knows."""
    while MADE:
        _delete(spark, MADE.pop())


def discard(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes the folders that this thread has made since MADE had ``since`` entries, but those of the names to keep: what nothing reads any more needs no disk."""
    for path in MADE[since:]:
        if MAKERS.get(path) == threading.get_ident() and path.rpartition("/")[2].rpartition("-")[0] not in keep:
            _delete(spark, path)
            MADE.remove(path)


def written(df: DataFrame, name: str, path: str | None = None, parts: int | None = None) -> DataFrame:
    """Writes a DataFrame as Parquet in the shared folder and reads it back: lineage ends there, on storage that outlives executors.

    ``parts`` is the most files that a thin table is written to, so that many partitions don't leave as many small files.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
