"""Corpus statistics: one plan each, nothing is pulled to the driver but the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import path_segments, query_key, query_parts


def percentage(value: Column, total: Column) -> Column:
    """0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(100.0 * value / F.nullif(total, F.lit(0)))


def basic(records: DataFrame) -> DataFrame:
    """Counts and exact distincts of a table of candidates, with shares in percent."""
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    counts = records.agg(
        F.count("*").alias("total_urls"),
        F.countDistinct("domain").alias("unique_domains"),
        F.count_if(F.lower("url_protocol") == "https").alias("https"),
        F.count_if(F.lower("url_protocol") == "http").alias("http"),
        F.count_if(there("url_path")).alias("urls_with_path"),
        F.count_if(there("url_query")).alias("urls_with_query"),
        F.count_if(F.locate("#", F.col("url")) > 0).alias("urls_with_fragment"),
    )
    return counts.withColumns({f"{c}_percent": F.round(percentage(F.col(c), F.col("total_urls")), 6) for c in ("https", "http", "urls_with_path", "urls_with_query", "urls_with_fragment")})


def lengths(records: DataFrame) -> DataFrame:
    """min, max, mean and exact interpolated percentiles of characters; 0 for an empty table."""
    n = F.length("url").cast("long")
    own = records.filter(F.col("url").isNotNull()).agg(F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.percentile(n, [0.5, 0.9, 0.95, 0.99]).alias("p"))
    double = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return own.select(F.coalesce("min", F.lit(0)).alias("min_length"), F.coalesce("max", F.lit(0)).alias("max_length"), double(F.col("mean")).alias("mean_length"), *[double(F.get("p", F.lit(k))).alias(name) for k, name in enumerate(("p50", "p90", "p95", "p99"))])


def frequencies(values: DataFrame) -> DataFrame:
    """value, count of a one-column table; nulls are left out."""
    return values.toDF("value").filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("count"))


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent, then by value: a report's list."""
    return counts.orderBy(F.desc("count"), "value").limit(n)


def domains(records: DataFrame) -> DataFrame:
    return frequencies(records.select("domain"))


def segments(records: DataFrame) -> DataFrame:
    return frequencies(records.select(F.explode(path_segments(F.col("url_path")))))


def query_keys(records: DataFrame) -> DataFrame:
    """Lower-case keys of non-empty parameters; an empty key counts."""
    return frequencies(records.select(F.explode(query_parts(F.col("url_query"))).alias("p")).select(F.lower(query_key(F.col("p")))))


def report(records: DataFrame, n: int = 100) -> DataFrame:
    """All of it as one row: figures, lengths, entropy and three lists of value and count."""
    from .ngrams import entropies, ngram_counts

    lists = [top(f(records), n).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "value", "count"))).alias(name)).select(F.transform(name, lambda x: F.struct(x["value"], x["count"])).alias(name)) for f, name in ((domains, "top_domains"), (segments, "top_path_segments"), (query_keys, "top_query_keys"))]
    out = basic(records).join(lengths(records), F.lit(True)).join(entropies(ngram_counts(records.select("url"), "url", [0]), [0]).select(F.col("h0").alias("byte_entropy")), F.lit(True), "left")
    for x in lists:
        out = out.join(x, F.lit(True))
    return out


def as_text(row) -> str:
    """A report row as text: figures first, then its lists as tables."""
    own = row.asDict(recursive=True)
    lines = [f"{k.replace('_', ' ') + ':':32}{f'{v:,.4f}' if isinstance(v, float) else f'{v:,}'}" for k, v in own.items() if isinstance(v, (int, float))]
    for k, v in own.items():
        if isinstance(v, list):
            lines += ["", k.replace("_", " ").upper(), *(f"{x['count']:>14,}  {x['value']}" for x in v)]
    return "\n".join(lines)


def table_text(rows: list, title: str) -> str:
    """Rows as a table of text below a title, each column as wide as its longest value; numbers to the right."""
    if not rows:
        return f"{title.upper()}\n(none)"
    shown = [[f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else "" if v is None else str(v) for v in r] for r in rows]
    names = list(rows[0].asDict())
    wide = [max(len(n), *(len(r[k]) for r in shown)) for k, n in enumerate(names)]
    right = [isinstance(v, (int, float)) for v in rows[0]]
    line = lambda cells: "  ".join(c.rjust(w) if x else c.ljust(w) for c, w, x in zip(cells, wide, right, strict=True)).rstrip()
    return "\n".join([title.upper(), line(names), *map(line, shown)])


def ngram_text(entropies: DataFrame, distinct: DataFrame) -> str:
    """The n-gram report: bytes and entropies, then how many different windows of each length there are."""
    lengths = distinct.select((F.col("k") + 1).alias("length"), "distinct_ngrams").orderBy("length")
    return table_text(entropies.orderBy("group").collect(), "entropy, bits a byte") + "\n\n" + table_text(lengths.collect(), "distinct n-grams")


def component_text(entropies: DataFrame) -> str:
    """The components' report: bytes and entropies of each, the largest first."""
    return table_text(entropies.orderBy(F.desc("bytes"), "group").withColumnRenamed("group", "component").collect(), "entropy of components, bits a byte")


def vocabulary_text(model, n: int = 20) -> str:
    """A vocabulary_model row: sizes, then the first n tokens of each list."""
    own = model.asDict(recursive=True)
    lines = [f"{k.replace('_', ' ') + ':':32}{v:,}" for k, v in own.items() if isinstance(v, int)]
    for k, v in own.items():
        if isinstance(v, list):
            lines += ["", k.replace("_", " ").upper(), *(f"{x['count']:>14,}  {x['value']}" for x in v[:n])]
    return "\n".join(lines)
