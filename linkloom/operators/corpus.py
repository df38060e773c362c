"""Corpus selection: filters, the ranked-domain semi join, deterministic samples, dedup, quotas and the final cut.

Where an order has to be random but the same each time, it is that of md5(url), then url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.sources.scratch import written

# What the selection leaves out, and its limits.
EXCLUDED_PATHS = ["/favicon.ico", "/robots.txt", "/sitemap.xml", "/sitemap_index.xml"]
PROTOCOLS = ["http", "https"]
MOST_CHARS = 4096
DOMAIN_QUOTA = 50
TARGET_URLS = 10_000_000
PER_SOURCE = 100_000


def random_order(url: str = "url") -> list[Column]:
    return [F.md5(F.col(url)), F.col(url)]


def wanted_urls(records: DataFrame, least: int = 0) -> DataFrame:
    """Rows with a URL of least+1 to MOST_CHARS characters, a domain, and http or https in small letters."""
    n = F.length("url")
    return records.filter(F.col("url").isNotNull() & F.col("domain").isNotNull() & F.col("url_protocol").isin(PROTOCOLS) & (n >= least) & (n <= MOST_CHARS))


def without_excluded_paths(records: DataFrame) -> DataFrame:
    """Keeps rows without a path."""
    return records.filter(F.col("url_path").isNull() | ~F.col("url_path").isin(EXCLUDED_PATHS))


def rank_list(lines: DataFrame) -> DataFrame:
    """rank, domain from two text columns: rows whose rank is digits and whose domain isn't blank, without a last dot."""
    domain = F.lower(F.regexp_replace(F.trim("column1"), "[.]$", ""))
    kept = lines.filter(F.col("column0").rlike("^[0-9]+$") & F.col("column1").isNotNull() & (F.length(F.trim("column1")) > 0))
    return kept.select(F.col("column0").try_cast("int").alias("rank"), domain.alias("domain"))


def in_training(url: Column, percent: int) -> Column:
    """The first four bytes of SHA-256 as a number, modulo 100, below ``percent``."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 8), 16, 10).cast("long") % 100 < percent


def of_ranked_domains(records: DataFrame, ranked: DataFrame) -> DataFrame:
    """Left semi join on the domain. Spark broadcasts the list while it measures below its threshold, else it shuffles."""
    return records.join(ranked.select("domain").distinct(), "domain", "left_semi").select(*records.columns)


def sample_per_source(records: DataFrame, source: str, n: int = PER_SOURCE) -> DataFrame:
    """The n rows of each source that come first in random order; a partial cut before the shuffle keeps hot sources small."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(*random_order()))
    return records.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def unique_urls(records: DataFrame) -> DataFrame:
    """One row for each URL, the smallest by its other columns, so that reruns agree. Copies meet partly before the shuffle."""
    rest = [c for c in records.columns if c != "url"]
    one = records.groupBy("url").agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select(*[F.col("url") if c == "url" else F.col(f"_row.{c}").alias(c) for c in records.columns])


def distinct_candidates(records: DataFrame) -> DataFrame:
    return without_excluded_paths(wanted_urls(records, 1)).select("url", "domain", "url_path").distinct()


def diversity_score() -> Column:
    """100 for a query, then length and slashes of the path, then a little for the URL's length."""
    path = F.coalesce("url_path", F.lit(""))
    slashes = F.length(F.regexp_replace(path, "[^/]", ""))
    has_query = F.when(F.col("url_query").isNotNull() & (F.col("url_query") != ""), 100).otherwise(0)
    return has_query + F.length(path) + slashes + F.length("url") / F.lit(1000.0)


def domain_ranks(records: DataFrame, quota: int) -> DataFrame:
    """Rows with domain_rank, by diversity, up to the quota; Spark cuts each domain before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy(diversity_score().desc(), *random_order()))
    return records.withColumn("domain_rank", place).filter(F.col("domain_rank") <= quota).withColumn("domain_rank", F.col("domain_rank").cast("long"))


def quota_by_hash(candidates: DataFrame, quota: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("domain").orderBy(*random_order()))
    return candidates.withColumn("_place", place).filter(F.col("_place") <= quota).drop("_place")


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """The n rows that come first in random order, without a global sort.

    Rows are counted by the first four hex digits of the hash, at most 65,536 groups. Groups wholly within n are kept as
    they are; only the group that n cuts is sorted. ``rows`` is read up to three times, so pass a stored table; a plan is
    worked out once if it goes through linkloom.sources.scratch.written() first, as select_training does.
    """
    rows = rows.withColumn("_h", F.substring(F.md5("url"), 1, 4))
    counts = rows.groupBy("_h").count().withColumn("upto", F.sum("count").over(Window.orderBy("_h")))
    cut = counts.filter(F.col("upto") > n).orderBy("_h").first()
    if cut is None:
        return rows.drop("_h")
    part = rows.filter(F.col("_h") == cut["_h"]).orderBy(*random_order()).limit(n - (cut["upto"] - cut["count"]))
    return rows.filter(F.col("_h") < cut["_h"]).unionAll(part).drop("_h")


def select_training(records: DataFrame, quota: int = DOMAIN_QUOTA, target: int = TARGET_URLS) -> DataFrame:
    """url of the selection: distinct wanted candidates, a quota by domain, then the target's number in random order."""
    return first_by_hash(written(quota_by_hash(distinct_candidates(records), quota).select("url"), "eligible"), target)


def host_of(url: Column) -> Column:
    """What the report counts as a domain: up to the first slash, colon, ? or #, so a user name if there is one."""
    return F.regexp_extract(url, "^(?:https?://)?([^/:?#]+)", 1)


def selection_report(records: DataFrame, selected: DataFrame, quota: int, target: int) -> DataFrame:
    """One row of structs: source, selection, output. Source figures take in the excluded paths."""
    source = wanted_urls(records, 1).agg(F.count("*").alias("candidate_rows"), F.countDistinct("url").alias("unique_urls"), F.countDistinct("domain").alias("unique_domains"))
    out = selected.agg(F.count("*").alias("selected_urls"), F.countDistinct(host_of(F.col("url"))).alias("hosts"))
    return source.join(out, F.lit(True)).select(
        F.struct("candidate_rows", "unique_urls", "unique_domains").alias("source"),
        F.struct(F.lit(target).cast("long").alias("target_urls"), "selected_urls", F.lit(quota).cast("long").alias("domain_quota"), F.array(*map(F.lit, EXCLUDED_PATHS)).alias("excluded_paths"), F.lit(MOST_CHARS).cast("long").alias("max_url_length")).alias("selection"),
        F.struct(F.col("hosts").alias("unique_domains")).alias("output"),
    )
