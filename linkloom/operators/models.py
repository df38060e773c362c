"""Vocabularies, and the order-0..3 context model (PPM) with its cost in bits as a plan of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.urls import host, path, query, query_key, query_parts

from .ngrams import ngram_counts
from .stats import frequencies

# Sizes of the vocabularies and of the model.
LABEL_LIMIT, SEGMENT_LIMIT, KEY_LIMIT, MIN_COUNT = 65536, 65536, 16384, 20
MAX_ORDER, TOP_K, PPM_MIN_COUNT, TRAIN_PERCENT = 3, 16, 2, 90


def label_counts(urls: DataFrame) -> DataFrame:
    labels = F.filter(F.split(F.lower(host(F.col("url"))), "[.]"), lambda x: x != "")
    return frequencies(urls.select(F.explode(labels)))


def segment_counts(urls: DataFrame) -> DataFrame:
    return frequencies(urls.select(F.explode(F.filter(F.split(path(F.col("url")), "/"), lambda x: x != ""))))


def key_counts(urls: DataFrame) -> DataFrame:
    """Lower-case keys; empty ones don't count here."""
    return frequencies(urls.select(F.explode(query_parts(query(F.col("url")))).alias("p")).select(F.lower(query_key(F.col("p"))))).filter("value <> ''")


def vocabulary(counts: DataFrame, limit: int, min_count: int = MIN_COUNT) -> DataFrame:
    """value, count, rank of the most frequent values, then by value. The rank is over at most ``limit`` rows."""
    kept = counts.filter(F.col("count") >= min_count).orderBy(F.desc("count"), "value").limit(limit)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "value")).cast("long"))


def vocabulary_model(urls: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """One row: version, three lists of tokens, and sizes before the limits."""
    parts = (("domain_labels", label_counts(urls), LABEL_LIMIT), ("path_segments", segment_counts(urls), SEGMENT_LIMIT), ("query_keys", key_counts(urls), KEY_LIMIT))
    out = urls.agg(F.lit(1).alias("version"), F.count("*").alias("urls"))
    for name, counts, limit in parts:
        tokens = vocabulary(counts, limit, min_count).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["value"], x["count"])).alias(name))
        out = out.join(tokens, F.lit(True)).join(counts.agg(F.count("*").alias(f"n_{name}")), F.lit(True))
    return out


def context_counts(urls: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """ctx_order, ctx_key, symbol, cnt: how often a byte follows each context of its URL; contexts don't cross URLs."""
    counts = ngram_counts(urls.filter("url <> ''"), "url", range(max_order + 1))
    return counts.select(F.col("k").alias("ctx_order"), F.shiftright("gram", 8).alias("ctx_key"), F.col("gram").bitwiseAND(255).cast("int").alias("symbol"), F.col("n").alias("cnt"))


def run_counters(urls: DataFrame, percent: int = TRAIN_PERCENT, max_order: int = MAX_ORDER) -> DataFrame:
    """One row: urls that aren't empty, those in training, their bytes, and distinct (context, symbol) entries."""
    from .corpus import in_training

    own = urls.filter("url <> ''").select("url", in_training(F.col("url"), percent).alias("t"))
    sums = own.agg(F.count("*").alias("urls"), F.count_if("t").alias("train_urls"), F.coalesce(F.sum(F.when(F.col("t"), F.octet_length("url").cast("long"))), F.lit(0)).alias("train_bytes"))
    return sums.join(context_counts(own.filter("t"), max_order).agg(F.count("*").alias("entries")), F.lit(True))


def context_model(counts: DataFrame, min_count: int = PPM_MIN_COUNT, top_k: int = TOP_K) -> DataFrame:
    """ctx_order, ctx_key, symbol, cnt, place, ctx_total, low, high: the symbols that a context keeps, with their intervals.

    Contexts of order 0 keep every byte; others those with ``min_count``, the ``top_k`` most frequent, then by symbol.
    Totals and intervals are over what is kept. A context has at most 256 symbols, so each window is small.
    """
    by = Window.partitionBy("ctx_order", "ctx_key")
    order = by.orderBy(F.desc("cnt"), "symbol")
    kept = counts.filter((F.col("ctx_order") == 0) | (F.col("cnt") >= min_count)).withColumn("place", F.row_number().over(order).cast("long"))
    kept = kept.filter((F.col("ctx_order") == 0) | (F.col("place") <= top_k)).withColumn("ctx_total", F.sum("cnt").over(by))
    kept = kept.withColumn("high", F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.select("ctx_order", "ctx_key", "symbol", "cnt", "place", "ctx_total", (F.col("high") - F.col("cnt")).alias("low"), "high")


def contexts(model: DataFrame) -> DataFrame:
    """ctx_order, ctx_key, ctx_total, symbols: a row for each context, symbols in coding order."""
    symbols = F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol", "cnt"))), lambda x: F.struct(x["symbol"], x["cnt"]))
    return model.groupBy("ctx_order", "ctx_key").agg(F.max("ctx_total").alias("ctx_total"), symbols.alias("symbols"))


def positions(urls: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """url_id, pos, symbol, ctx_order, ctx_key: each byte of each URL with its contexts of order 1 up to max_order; one row without a context if it has none.

    The context of order 0 is left out: all bytes share it, and a join on it would send them all to one task. Only short
    slices of the URL ride on the exploded rows.
    """
    data = F.col("url").cast("binary")
    cells = F.transform(F.sequence(F.lit(1), F.octet_length("url")), lambda i: F.struct(i.alias("pos"), F.hex(F.substring(data, F.greatest(i - max_order, F.lit(1)), F.least(i, F.lit(max_order + 1)))).alias("h")))
    rows = urls.filter(F.octet_length("url") > 0).select("url_id", F.explode(cells).alias("c")).select("url_id", "c.pos", "c.h")
    longest = (F.length("h") / 2 - 1).cast("int")
    order = F.explode(F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array(F.lit(None).cast("int")))).alias("ctx_order")
    rows = rows.select("url_id", "pos", "h", order)
    number = lambda text: F.conv(text, 16, 10).cast("long")
    key = number(F.substring(F.col("h"), F.length("h") - 1 - 2 * F.col("ctx_order"), 2 * F.col("ctx_order")))
    return rows.select("url_id", "pos", number(F.substring(F.col("h"), F.length("h") - 1, F.lit(2))).cast("int").alias("symbol"), "ctx_order", key.alias("ctx_key"))


def order_zero(model: DataFrame) -> DataFrame:
    """symbol, cnt0, total0 for all 256 bytes: the model's context of order 0, null where it has none. At most 256 rows of the model go through it."""
    zero = model.filter("ctx_order = 0")
    own, total = zero.select(F.col("symbol").alias("s"), F.col("cnt").alias("cnt0")), zero.agg(F.max("ctx_total").alias("total0"))
    every = model.sparkSession.range(256).select(F.col("id").cast("int").alias("symbol"))
    return every.join(F.broadcast(own), F.col("symbol") == F.col("s"), "left").join(F.broadcast(total), F.lit(True), "left").select("symbol", "cnt0", "total0")


def best_contexts(urls: DataFrame, model: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """url_id, pos, best_order: the highest order whose context the model knows; -1 if it knows none."""
    known = model.filter("ctx_order > 0").select("ctx_order", "ctx_key").distinct().withColumn("known", F.lit(True))
    found = positions(urls, max_order).join(known, ["ctx_order", "ctx_key"], "left")
    best = found.groupBy("url_id", "pos", "symbol").agg(F.max(F.when(F.col("known"), F.col("ctx_order"))).alias("o"))
    least = F.when(F.col("total0").isNotNull(), 0).otherwise(-1)
    return best.join(F.broadcast(order_zero(model)), "symbol", "left").select("url_id", "pos", F.coalesce("o", least).cast("long").alias("best_order"))


def ideal_bits(urls: DataFrame, model: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """url_id, n_bytes, bits: what the coder would take, without running it.

    A byte costs an escape, log2(total + 1), in each known context above the one that holds it, and its own share there; if
    none does, all the escapes and eight bits. Order 0 comes from a table of 256 rows.
    """
    above = model.filter("ctx_order > 0")
    totals = above.groupBy("ctx_order", "ctx_key").agg(F.max("ctx_total").alias("ctx_total"))
    entries = above.select("ctx_order", "ctx_key", "symbol", "cnt")
    found = positions(urls, max_order).join(totals, ["ctx_order", "ctx_key"], "left").join(entries, ["ctx_order", "ctx_key", "symbol"], "left")
    cells = F.struct(F.col("ctx_order").alias("o"), F.log2(F.col("ctx_total") + 1).alias("esc"), (F.log2(F.col("ctx_total") + 1) - F.log2("cnt")).alias("own"))
    rows = found.groupBy("url_id", "pos", "symbol").agg(F.max(F.when(F.col("cnt").isNotNull(), cells)).alias("hit"), F.collect_list(F.when(F.col("ctx_total").isNotNull(), cells)).alias("known"))
    escapes = F.aggregate(F.filter("known", lambda x: F.col("hit").isNull() | (x["o"] > F.col("hit.o"))), F.lit(0.0), lambda a, x: a + x["esc"])
    zero = F.coalesce(F.log2(F.col("total0") + 1), F.lit(0.0)) + F.coalesce(-F.log2("cnt0"), F.lit(8.0))
    rows = rows.join(F.broadcast(order_zero(model)), "symbol", "left")
    return rows.groupBy("url_id").agg(F.count("*").alias("n_bytes"), F.round(F.sum(escapes + F.coalesce(F.col("hit.own"), zero)), 4).alias("bits"))
