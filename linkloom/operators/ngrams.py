"""Byte n-grams and the conditional entropies that they give, for whole URLs and for their components.

Counting looks at every byte several times, so it runs on Arrow's own buffers in numpy, batch by batch and without a loop
over rows; only distinct n-grams of a batch go on to Spark's aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import form_decoded, fragment, host, path, percent_decoded, query, scheme

COMPONENTS = ["whole_url", "scheme", "domain", "path", "query_key", "query_value", "fragment"]
CHUNK = 4 << 20  # bytes that are counted at a time


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and the row of each."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, np.repeat(np.arange(len(column)), np.diff(ends))


def _counts(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (k+1)-byte windows within rows as big-endian numbers, with their counts."""
    data, row = _bytes(column)
    n = len(data) - k
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = np.zeros(n, np.int64)
    for j in range(k + 1):
        gram = gram << 8 | data[j : j + n]
    return np.unique(gram[row[:n] == row[k:]], return_counts=True)


def ngram_counts(rows: DataFrame, text: str, orders: Sequence[int], group: str | None = None) -> DataFrame:
    """group, k, gram, n: how often each (k+1)-byte window occurs within the rows of a group, for each order k up to 6.

    ``gram`` holds the bytes as a big-endian number, so gram >> 8 is the context and gram & 255 the byte after it.
    """
    orders = list(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            for g, name in enumerate(names.dictionary.to_pylist()):
                column = batch.column(1).filter(pa.compute.equal(names.indices, g))
                size, begin = 0, 0
                cuts = []
                for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
                    size += n or 0
                    if size >= CHUNK:
                        cuts.append((begin, i + 1))
                        begin, size = i + 1, 0
                for a, b in [*cuts, (begin, len(column))]:
                    for k in orders:
                        gram, n = _counts(column.slice(a, b - a), k)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array([k] * len(gram), pa.int32()), pa.array(gram), pa.array(n)], ["group", "k", "gram", "n"])

    import pyarrow.compute  # noqa: F401

    own = rows.select((F.col(group) if group else F.lit("all")).alias("group"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return own.mapInArrow(run, "group string, k int, gram long, n long").groupBy("group", "k", "gram").agg(F.sum("n").alias("n"))


def entropies(counts: DataFrame, orders: Sequence[int] = range(5)) -> DataFrame:
    """group, bytes, h0..h4 in bits for each group of ngram_counts, rounded to six digits.

    With count c of an n-gram, C of its context and T bytes in all, H_k = sum of c / (T - k) * log2(C / c). The divisor
    takes the corpus as one string although windows end with their row. Written as (sum of C log2 C - sum of c log2 c)
    / (T - k), it needs two aggregations and neither a window nor a join. Where T is not over k, it is 0.
    """
    by_context = counts.groupBy("group", "k", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    sums = by_context.groupBy("group").agg(
        F.coalesce(F.sum(F.when(F.col("k") == 0, F.col("all"))), F.lit(0)).alias("bytes"),
        *[F.sum(F.when(F.col("k") == k, F.col("all") * F.log2("all") - F.col("own"))).alias(f"_{k}") for k in orders],
    )
    return sums.select("group", "bytes", *[F.round(F.when(F.col("bytes") > k, F.coalesce(f"_{k}", F.lit(0.0)) / F.greatest(F.col("bytes") - k, F.lit(1))).otherwise(0.0), 6).alias(f"h{k}") for k in orders])


def distinct_ngrams(counts: DataFrame) -> DataFrame:
    """k, distinct: how many different windows there are."""
    return counts.groupBy("k").agg(F.count("*").alias("distinct_ngrams"))


def components(urls: DataFrame, url: str = "url") -> DataFrame:
    """component, text: what each URL adds to the seven components.

    The whole URL always counts. Each distinct query key counts once a URL, a value each time; pairs with a semicolon or
    a broken escape are left out, as is the path's decoding.
    """
    u = F.col(url)
    pairs = F.filter(F.split(F.coalesce(query(u), F.lit("")), "&"), lambda x: (x != "") & (F.instr(x, ";") == 0))
    keys = F.transform(pairs, lambda x: form_decoded(F.split_part(x, F.lit("="), F.lit(1))))
    values = F.transform(pairs, lambda x: F.when(F.instr(x, "=") > 0, form_decoded(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise(F.lit("")))
    whole = urls.select(u.alias("u"), F.arrays_zip(keys.alias("k"), values.alias("v")).alias("p")).withColumn("p", F.filter("p", lambda x: x["k"].isNotNull() & x["v"].isNotNull()))
    u = F.col("u")
    one = lambda name, text: F.struct(F.lit(name).alias("component"), F.coalesce(text, F.lit("")).alias("text"))
    parts = F.array(one("whole_url", u), one("scheme", scheme(u)), one("domain", host(u)), one("path", path(u)), one("fragment", percent_decoded(fragment(u))))
    named = lambda name, texts: F.transform(texts, lambda x: F.struct(F.lit(name).alias("component"), x.alias("text")))
    every = F.concat(parts, named("query_key", F.array_distinct(F.transform("p", lambda x: x["k"]))), named("query_value", F.transform("p", lambda x: x["v"])))
    return whole.filter(u.isNotNull()).select(F.explode(every).alias("c")).select("c.component", "c.text").filter("text <> ''")
