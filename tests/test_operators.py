import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators import corpus, models, ngrams, stats


def urls(spark, values):
    return spark.createDataFrame([(u,) for u in values], "url string")


def test_url_parts(spark):
    cases = {
        "https://User:pw@Www.Example.com:8443/a/b?x=1&y#top": ("www.example.com", "https", "/a/b", "x=1&y", 8443),
        "http://[2001:db8::1]:80/": ("2001:db8::1", "http", "/", None, 80),
        "HTTP://e.com?": ("e.com", "http", "", None, None),
        "http://e.com:70000/x?#": ("e.com", "http", "/x", None, None),
        "mailto:a@b": ("", "mailto", "a@b", None, None),
        "no scheme at all": ("", "", "no scheme at all", None, None),
        "": ("", "", "", None, None),
    }
    for r in U.url_records(urls(spark, cases)).collect():
        assert tuple(r)[1:] == cases[r["url"]], r["url"]
    assert U.url_records(urls(spark, [None])).first()["domain"] is None


def test_decoding(spark):
    r = urls(spark, ["a%20b+c", "%zz", None]).select(U.percent_decoded(F.col("url")).alias("p"), U.form_decoded(F.col("url")).alias("f")).collect()
    assert [tuple(x) for x in r] == [("a b+c", "a b c"), (None, None), (None, None)]


def records(spark, rows):
    return spark.createDataFrame(rows, "url string, domain string, url_protocol string, url_path string, url_query string, url_port int")


def test_filters(spark):
    own = records(spark, [("http://a/x", "a", "http", "/x", None, None), ("http://a/r", "a", "http", "/robots.txt", None, None), ("http://a/n", "a", "http", None, None, None), ("u", "a", "HTTP", "/", None, None), ("u", None, "http", "/", None, None), (None, "a", "http", "/", None, None), ("", "a", "http", "/", None, None), ("h" * 4097, "a", "http", "/", None, None), ("h" * 4096, "a", "http", "/", None, None)])
    assert sorted(len(r["url"]) for r in corpus.wanted_urls(own).collect()) == [0, 10, 10, 10, 4096]
    assert sorted(r["url_path"] or "" for r in corpus.without_excluded_paths(corpus.wanted_urls(own, 1)).collect()) == ["", "/", "/x"]


def test_rank_list(spark):
    lines = spark.createDataFrame([("1", " Example.COM. "), ("x", "a.com"), ("2", "  "), ("3", None), (None, "b.com"), ("12345678901234", "c.com")], "column0 string, column1 string")
    assert sorted(map(tuple, corpus.rank_list(lines).collect()), key=repr) == [(1, "example.com"), (None, "c.com")]


def test_split_is_that_of_sha256(spark):
    values = [f"http://e.com/{k}" for k in range(200)]
    got = {r["url"]: r["t"] for r in urls(spark, values).select("url", corpus.in_training(F.col("url"), 30).alias("t")).collect()}
    assert got == {u: int(hashlib.sha256(u.encode()).hexdigest()[:8], 16) % 100 < 30 for u in values}


def test_dedup_takes_the_smallest_row(spark):
    own = records(spark, [("u", "b", "http", "/", None, 1), ("u", "a", "http", "/", None, 2), ("v", None, None, None, None, None)])
    assert sorted(map(tuple, corpus.unique_urls(own).collect()), key=repr) == [("u", "a", "http", "/", None, 2), ("v", None, None, None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 7, 300, 1000])
def test_first_by_hash(spark, n):
    values = [f"http://e.com/{k}" for k in range(300)]
    got = sorted(r["url"] for r in corpus.first_by_hash(urls(spark, values), n).collect())
    assert got == sorted(sorted(values, key=lambda u: (hashlib.md5(u.encode()).hexdigest(), u))[:n])


def test_quota(spark):
    own = records(spark, [(f"http://a/{'x' * k}", "a", "http", "/" + "x" * k, "q" if k == 3 else None, None) for k in range(6)] + [("http://b/", "b", "http", None, None, None)])
    got = sorted((r["domain"], r["domain_rank"], r["url_path"]) for r in corpus.domain_ranks(own, 2).collect())
    assert got == [("a", 1, "/xxx"), ("a", 2, "/xxxxx"), ("b", 1, None)]


def test_empty_tables(spark):
    none = records(spark, [])
    assert tuple(stats.lengths(none).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    r = stats.basic(none).first()
    assert r["total_urls"] == 0 and r["https_percent"] == 0.0
    assert corpus.select_training(none, 3, 10).count() == 0
    assert ngrams.entropies(ngrams.ngram_counts(none, "url", range(5))).count() == 0
    assert models.context_model(models.context_counts(none)).count() == 0
    assert models.vocabulary_model(none).first()["n_query_keys"] == 0
    assert stats.report(none).first()["top_domains"] == []


def test_query_keys(spark):
    own = records(spark, [("u", "d", "http", "/a//b/", "=v&&K=1&k", None)])
    assert {r["value"]: r["count"] for r in stats.query_keys(own).collect()} == {"": 1, "k": 2}
    assert {r["value"]: r["count"] for r in stats.segments(own).collect()} == {"a": 1, "b": 1}
    assert {r["value"] for r in models.key_counts(urls(spark, ["http://e.com/?=v&&K=1&k"])).collect()} == {"k"}


def entropy_by_hand(texts, k):
    total = sum(len(t) for t in texts)
    grams, contexts = Counter(), Counter()
    for t in texts:
        for i in range(len(t) - k):
            grams[t[i : i + k + 1]] += 1
            contexts[t[i : i + k]] += 1
    return round(sum(c / (total - k) * -math.log2(c / contexts[g[:-1]]) for g, c in grams.items()), 6) if total > k else 0.0


def test_entropies(spark):
    texts = ["banana", "bandana", "", "é", "a", None, "x" * 50]
    r = ngrams.entropies(ngrams.ngram_counts(urls(spark, texts), "url", range(5))).first()
    data = [(t or "").encode() for t in texts]
    assert r["bytes"] == sum(map(len, data))
    for k in range(5):
        assert r[f"h{k}"] == pytest.approx(entropy_by_hand(data, k), abs=2e-6)


def test_document_entropies_of_all_orders(spark, sf_dir):
    from linkloom.plans.queries import QUERIES

    data = [(r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    r = QUERIES["document_byte_entropy"](spark, sf_dir).first()
    assert r["bytes"] == sum(map(len, data))
    for k in range(5):
        assert r[f"h{k}"] == pytest.approx(entropy_by_hand(data, k), abs=2e-6) and r[f"h{k}"] > 0


def test_ngrams_are_the_same_in_any_chunks(spark, monkeypatch):
    texts = [f"http://e.com/{k}" for k in range(200)]
    whole = sorted(map(tuple, ngrams.ngram_counts(urls(spark, texts), "url", [2]).collect()))
    monkeypatch.setattr(ngrams, "CHUNK", 50)
    assert sorted(map(tuple, ngrams.ngram_counts(urls(spark, texts).coalesce(1), "url", [2]).collect())) == whole


def test_components(spark):
    got = Counter(tuple(r) for r in ngrams.components(urls(spark, ["https://Ab.com:1/x%20y?k=1&k=a%20b&z&q=%zz&p;r=1#f%41", None])).collect())
    assert got == Counter({("whole_url", "https://Ab.com:1/x%20y?k=1&k=a%20b&z&q=%zz&p;r=1#f%41"): 1, ("scheme", "https"): 1, ("domain", "Ab.com"): 1, ("path", "/x%20y"): 1, ("query_key", "k"): 1, ("query_key", "z"): 1, ("query_value", "1"): 1, ("query_value", "a b"): 1, ("fragment", "fA"): 1})


def test_vocabulary(spark):
    model = models.vocabulary_model(urls(spark, ["http://a.com/x/y?k=1"] * 3 + ["http://b.com/x"]), 2).first().asDict(recursive=True)
    assert model["domain_labels"] == [{"value": "com", "count": 4}, {"value": "a", "count": 3}]
    assert model["path_segments"] == [{"value": "x", "count": 4}, {"value": "y", "count": 3}]
    assert (model["urls"], model["n_domain_labels"], model["n_query_keys"]) == (4, 3, 1)


def test_context_model(spark):
    counts = models.context_counts(urls(spark, ["ab", "ab", "ac", ""]))
    got = {(r["ctx_order"], r["ctx_key"], r["symbol"]): (r["cnt"], r["low"], r["high"], r["ctx_total"]) for r in models.context_model(counts).collect()}
    assert got == {(0, 0, 97): (3, 0, 3, 6), (0, 0, 98): (2, 3, 5, 6), (0, 0, 99): (1, 5, 6, 6), (1, 97, 98): (2, 0, 2, 2)}
    assert models.context_model(counts, 1, 1).filter("ctx_order = 1").count() == 1


def test_report_text(spark):
    own = records(spark, [("http://a/x?k=1", "a", "http", "/x", "k=1", None)] * 2)
    text = stats.as_text(stats.report(own, 5).first())
    assert "TOP DOMAINS\n             2  a" in text and "total urls:" in text and "100.0000" in text


def test_semantic_inverse(spark):
    cases = {"https://www.e.com:81/a?b#c": "https://www.e.com:81/a?b#c", "HTTP://WWW.e.com": "http://www.e.com", "http://e.com/%41": "http://e.com/A", "mailto:x": "mailto://"}
    got = urls(spark, cases).select("url", U.semantic_url(U.semantic(F.col("url"))).alias("u")).collect()
    assert {r["url"]: r["u"] for r in got} == cases


def test_reports_as_text(spark):
    own = urls(spark, ["http://a.com/x?k=1"] * 3 + ["http://b.com/x"])
    text = stats.ngram_text(ngrams.entropies(ngrams.ngram_counts(own, "url", range(5))), ngrams.distinct_ngrams(ngrams.ngram_counts(own, "url", range(5))))
    assert "ENTROPY, BITS A BYTE\n" in text and "DISTINCT N-GRAMS\n" in text and len(text.splitlines()) == 3 + 1 + 7
    text = stats.component_text(ngrams.entropies(ngrams.ngram_counts(ngrams.components(own), "text", range(5), "component")))
    assert text.splitlines()[2].startswith("whole_url") and "query_value" in text
    text = stats.vocabulary_text(models.vocabulary_model(own, 2).first(), 1)
    assert "DOMAIN LABELS\n             4  com\n\n" in text and "urls:" in text
    assert stats.table_text([], "none") == "NONE\n(none)"


def test_contexts_of_order_zero(spark):
    """A model without order 0, one with it alone, and one with all, on bytes that it knows and doesn't."""
    own = spark.createDataFrame([(1, "aab"), (2, "b"), (3, "zé"), (4, "")], "url_id int, url string")
    counts = models.context_counts(urls(spark, ["aab", "ab"]))
    bits = lambda m: {r["url_id"]: r["bits"] for r in models.ideal_bits(own, models.context_model(m, 1)).collect()}
    best = lambda m: {(r["url_id"], r["pos"]): r["best_order"] for r in models.best_contexts(own, models.context_model(m, 1)).collect()}
    log = math.log2
    zero = counts.filter("ctx_order = 0")  # a 3, b 2
    assert bits(zero) == pytest.approx({1: 2 * (log(6) - log(3)) + log(6) - log(2), 2: log(6) - log(2), 3: 3 * (log(6) + 8)}, abs=1e-4)
    assert bits(counts.filter("ctx_order = 9")) == {1: 24.0, 2: 8.0, 3: 24.0}
    one = counts.filter("ctx_order = 1")  # a: b 2, a 1
    assert bits(one) == pytest.approx({1: 8 + log(4) - log(1) + log(4) - log(2), 2: 8, 3: 24}, abs=1e-4)
    assert set(best(zero).values()) == {0} and set(best(counts.filter("ctx_order = 9")).values()) == {-1}
    assert best(one) == {(1, 1): -1, (1, 2): 1, (1, 3): 1, (2, 1): -1, (3, 1): -1, (3, 2): -1, (3, 3): -1}
