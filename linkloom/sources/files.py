"""Files in whatever store Spark is set up for, through Hadoop's file systems."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

ASIDE = ".old"  # ends the name of a folder that is being replaced

def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Full paths of what a folder holds, in order."""
    store, p = _at(spark, folder)
    return sorted(str(x.getPath().toString()) for x in store.listStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    store, p = _at(spark, path)
    store.delete(p, True)


def publish(spark: SparkSession, temporary: str, final: str) -> None:
    """Puts a finished file or folder in place of another.

    A file replaces a file in one step, so readers see the old one or the new one and there always is one. No store replaces
    a folder that isn't empty: the old one is moved aside, the new one put in its place, and the old one deleted. If that
    stops half-way, recover() brings the old one back.
    """
    store, to = _at(spark, final)
    _, frm = _at(spark, temporary)
    if to.getParent() is not None:
        store.mkdirs(to.getParent())
    aside = None
    if store.exists(to) and store.getFileStatus(to).isDirectory():
        aside = _at(spark, f"{final}{ASIDE}")[1]
        store.delete(aside, True)
        if not store.rename(to, aside):
            raise OSError(f"{final} can't be moved aside")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(frm).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(store.makeQualified(frm), store.makeQualified(to), how)
    if aside is not None:
        store.delete(aside, True)


def recover(spark: SparkSession, final: str) -> None:
    """Takes up a folder whose replacement stopped half-way: the old one comes back if there is no new one, else it goes."""
    store, to = _at(spark, final)
    aside = _at(spark, f"{final}{ASIDE}")[1]
    if store.exists(aside):
        if store.exists(to):
            store.delete(aside, True)
        else:
            store.rename(aside, to)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes beside the file first, then renames."""
    store, p = _at(spark, f"{path}.tmp")
    out = store.create(p, True)
    try:
        out.write(bytearray(data), 0, len(data))
    finally:
        out.close()
    publish(spark, f"{path}.tmp", path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"])


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_bytes(spark, path, json.dumps(value, indent=2, ensure_ascii=False).encode())


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_bytes(spark, path))


def write_row(spark: SparkSession, path: str, row) -> None:
    """A one-row report as indented JSON."""
    write_json(spark, path, row.asDict(recursive=True))
