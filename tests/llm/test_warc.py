import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from linkloom.llm import warc as W

PAGES = "page_id long, url string, html string, digest string, copies int"
def stamp():
    return F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.col("page_id"), F.lit(0)) % 7)


def page_rows():
    rng = random.Random(3)
    big = ["x" * 1000, "é" * 500, "y" * 999, "z" * 5000 + "\r\n\r\nWARC/1.1\r\n"]
    rows = [(k, f"http://www.H{k % 4}.com/p?{rng.randrange(5)}#f", rng.choice([*big, f"page {k}", "", None]), "d", 1) for k in range(120)]
    rows += [(7, *rows[7][1:]), (None, None, big[0], None, None), (None, "u\r\nX: y", "only here " * 200, None, None), (500, "http://a.com:80", big[0], "d", 2)]
    return rows


def by_hand(rows):
    groups = {}
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        if len(data) >= 1000 and p is not None:
            groups[data] = max(groups.get(data, p), p)
    out = []
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        held = groups.get(data, p) if len(data) >= 1000 else p
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if held == p else "revisit", None if held == p else held))
    return sorted(out, key=repr)


def test_captures(spark):
    got = W.capture_history(spark.createDataFrame(page_rows(), PAGES).repartition(5), stamp())
    rows = got.collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rows), key=repr) == by_hand(page_rows())
    rows.sort(key=lambda r: (r["index_range"], r["index_pos"]))
    keys = [(bytes(r["key"]), r["stamp"], -1 if r["page_id"] is None else r["page_id"]) for r in rows]
    assert keys == sorted(keys)


def test_archives_stay_small_and_long_pages_whole(spark, tmp_path):
    long = "<p>" + "long page " * 300_000
    rows = [*page_rows(), (900, "http://long.com/", long, "d", 0), (901, "http://long.com/2", long, "d", 0)]
    archives = W.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), stamp(), f"file://{tmp_path}/w", archive_bytes=500)
    assert archives.count() > 20
    got = W.read_archives(archives).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == by_hand(rows)
    index = W.merge_index(archives.select("run", "n_rows"), f"file://{tmp_path}/w", fan_in=4, range_rows=30)
    assert {(r["file"], r["offset"]) for r in index.collect()} == {(r["file"], r["offset"]) for r in got}


def test_empty(spark):
    assert W.capture_history(spark.createDataFrame([], PAGES), stamp()).count() == 0


def test_url_key(spark):
    cases = {"https://www.Example.com:443/A?b#c": "com,example)/a?b", "http://u:p@e.com": "com,e)/", "e.com/x": "com,e)/x", "": "", "http://e.com:8080/": "com,e:8080)/"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", W.url_key(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in got} == cases
    assert spark.sql("select cast(null as string) u").select(W.url_key(F.col("u"))).first()[0] == ""


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(30))) for _ in range(k)]
    assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_merge_in_passes_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "RUN_ROWS", 16)
    rng, every, runs = random.Random(1), [], []
    for n in range(11):
        rows = sorted(((f"k{rng.randrange(6)}".encode(), f"{rng.randrange(100):014d}", rng.choice([None, *range(50)]), f"f{n}", i, 1) for i in range(rng.randrange(100))), key=W.sort_key)
        with open(tmp_path / f"{n}.arrow", "wb") as f:
            W.write_run(f, iter(rows))
        every += rows
        runs.append((f"file://{tmp_path}/{n}.arrow", len(rows)))
    table = spark.createDataFrame(runs, "run string, n_rows long")
    for fan_in, size in ((512, 10**6), (3, 40), (2, 7)):
        got = W.merge_index(table, f"file://{tmp_path}/out-{fan_in}-{size}", fan_in, size).orderBy("index_range", "index_pos").collect()
        keys = [W.sort_key((bytes(r["key"]), r["stamp"], r["page_id"])) for r in got]
        assert keys == sorted(W.sort_key(x) for x in every)
        assert sorted((r["file"], r["offset"]) for r in got) == sorted((x[3], x[4]) for x in every)
        assert size > 100 or max(r["index_range"] for r in got) > 2


def test_records():
    body = "é\r\n\r\n" * 300
    data = body.encode()
    digest = hashlib.sha1(data).hexdigest()
    two = W.record(5, "http://e.com/é", "20200102030405", digest, len(data), data, None) + W.record(6, "u", "20200102030405", digest, len(data), None, 5)
    for chunk in (1, 7, 1 << 20):
        first, second = (W.parse_record(x[2]) for x in W.read_archive(io.BytesIO(two), chunk))
        assert (first["payload"], first["url"], first["record_type"], first["page_id"]) == (data, "http://e.com/é", "response", 5)
        assert (second["record_type"], second["refers_to"], second["payload_bytes"], second["payload_digest"]) == ("revisit", 5, len(data), digest)
    with pytest.raises(ValueError):
        list(W.read_archive(io.BytesIO(two[:-3])))
    raw = next(W.read_archive(io.BytesIO(two)))[2]
    for bad in (raw.replace(b"\xc3", b"\xc4", 2), raw[:-1], b"x" + raw):
        with pytest.raises(ValueError):
            W.parse_record(bad)


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = W.op7_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)
