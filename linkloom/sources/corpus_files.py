"""Readers and writers of the corpus: manifests, crawl rows, candidate shards, rank lists, URL text."""

from __future__ import annotations

import gzip
import re
import urllib.request
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

SHARD = re.compile(r"shard-[0-9]{4}\.parquet")
CANDIDATE = "url string, domain string, url_protocol string, url_path string, url_query string, url_port int"


def manifest(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """path: one line each of a text file, gzipped or not, stripped, blank lines left out, behind a base URL. Empty: an error.

    A list at an http or https address is fetched by the driver; it names a crawl's files, some hundreds.
    """
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path, timeout=60) as answer:
            data = answer.read()
        text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
        found = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    else:
        found = spark.read.text(path)
    lines = found.select(F.trim(F.regexp_replace("value", "\\s", " ")).alias("v")).filter("v <> ''").select(F.concat(F.lit(base), "v").alias("path"))
    if not lines.limit(1).count():
        raise ValueError(f"{path} lists nothing")
    return lines


def crawl_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of a crawl index as candidates: the registered domain in lower case."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    return rows.select("url", F.lower("url_host_registered_domain").alias("domain"), "url_protocol", "url_path", "url_query", F.col("url_port").cast("int").alias("url_port"))


def shard_paths(spark: SparkSession, path: str) -> list[str]:
    """A finished shard itself, or those of a folder in order; a temporary file, another name or none at all is an error."""
    name = path.rstrip("/").rpartition("/")[2]
    if name.endswith(".parquet"):
        if name.endswith(".tmp.parquet"):
            raise ValueError(f"{path} isn't finished")
        return [path]
    found = [p for p in files.names(spark, path) if SHARD.fullmatch(p.rpartition("/")[2])]
    if not found:
        raise ValueError(f"{path} has no shards")
    return found


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All shards as one table, columns matched by name."""
    return spark.read.option("mergeSchema", "true").parquet(*shard_paths(spark, path))


def write_rank_lines(rows: DataFrame, path: str) -> None:
    """Two text columns as a CSV file without a header, spaces kept."""
    rows.select("column0", "column1").write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def rank_lines(spark: SparkSession, path: str) -> DataFrame:
    """column0, column1 of a CSV file without a header, as text."""
    return spark.read.schema("column0 string, column1 string").csv(path)


def url_lines(spark: SparkSession, path: str, blank: bool = True) -> DataFrame:
    """url: one a line, without a last carriage return. Lines may be of any length and hold commas, tabs and quotes."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r\\z", "").alias("url"))
    return lines if blank else lines.filter("url <> ''")


def write_shard(rows: DataFrame, path: str) -> int:
    """Writes Parquet under a temporary name and publishes it; a shard that exists isn't replaced. Returns its rows, read again."""
    spark = rows.sparkSession
    if files.exists(spark, path):
        raise FileExistsError(path)
    temporary = path.removesuffix(".parquet") + f".{uuid.uuid4().hex}.tmp.parquet"
    rows.write.option("compression", "zstd").parquet(temporary)
    files.publish(spark, temporary, path)
    return spark.read.parquet(path).count()


def write_urls(rows: DataFrame, path: str, expected: int | None = None, parts: int | None = None) -> int:
    """Writes urls as text, one a line, without quotes, and publishes the folder once its lines have been counted.

    Part files stay as many as Spark has tasks, unless ``parts`` says else: one file would take one task.
    """
    spark, temporary = rows.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    urls = rows.select("url")
    (urls.coalesce(parts) if parts else urls).write.text(temporary)
    n = spark.read.text(temporary).count()
    if expected is not None and n != expected:
        files.delete(spark, temporary)
        raise ValueError(f"{n} lines were written, {expected} expected")
    files.publish(spark, temporary, path)
    return n
