import functools
import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from linkloom.operators import models
from linkloom.sources import corpus_files, files, ppm_model
from linkloom.streaming import collect


def test_manifest(spark, tmp_path):
    with gzip.open(tmp_path / "m.gz", "wt") as f:
        f.write("  a/b.parquet \n\n\nc.parquet\n")
    assert [r["path"] for r in corpus_files.manifest(spark, f"{tmp_path}/m.gz", "s3://x/").collect()] == ["s3://x/a/b.parquet", "s3://x/c.parquet"]
    (tmp_path / "none").write_text("\n \n")
    with pytest.raises(ValueError):
        corpus_files.manifest(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("packed", [False, True])
def test_manifest_from_a_server(spark, tmp_path, packed):
    data = b"  a/b.parquet \r\n\n\nc.parquet\n"
    (tmp_path / "list").write_bytes(gzip.compress(data) if packed else data)
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=tmp_path)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        got = corpus_files.manifest(spark, f"http://127.0.0.1:{server.server_port}/list", "b/").collect()
        server.shutdown()
    assert [r["path"] for r in got] == ["b/a/b.parquet", "b/c.parquet"]


def test_files_are_replaced_in_one_step(spark, tmp_path):
    files.write_json(spark, f"{tmp_path}/state.json", {"a": 1})
    files.write_json(spark, f"{tmp_path}/state.json", {"a": 2})
    assert files.read_json(spark, f"{tmp_path}/state.json") == {"a": 2}
    assert [p.rpartition("/")[2] for p in files.names(spark, str(tmp_path))] == ["state.json"]


def test_a_folder_whose_replacement_stops_comes_back(spark, tmp_path):
    one = lambda x: spark.createDataFrame([(x,)], "url string")
    corpus_files.write_urls(one("old"), f"{tmp_path}/urls")
    one("new").write.text(f"{tmp_path}/new")
    read = lambda: [r["url"] for r in corpus_files.url_lines(spark, f"{tmp_path}/urls").collect()]
    (tmp_path / "urls").rename(tmp_path / f"urls{files.ASIDE}")  # it stopped between the two renames
    files.recover(spark, f"{tmp_path}/urls")
    assert read() == ["old"]
    files.publish(spark, f"{tmp_path}/new", f"{tmp_path}/urls")
    assert read() == ["new"]
    (tmp_path / f"urls{files.ASIDE}").mkdir()  # it stopped before the old one was deleted
    files.recover(spark, f"{tmp_path}/urls")
    assert read() == ["new"] and sorted(p.name for p in tmp_path.iterdir()) == ["urls"]


def test_lines(spark, tmp_path):
    (tmp_path / "u").write_bytes(b'http://a/,"x"\r\n\nhttp://b/\ty\n' + b"h" * 100_000 + b"\r\r\n")
    got = [r["url"] for r in corpus_files.url_lines(spark, f"{tmp_path}/u").collect()]
    assert got == ['http://a/,"x"', "", "http://b/\ty", "h" * 100_000 + "\r"]
    assert corpus_files.url_lines(spark, f"{tmp_path}/u", blank=False).count() == 3


def test_rank_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,a.com\nx\n")
    assert [tuple(r) for r in corpus_files.rank_lines(spark, f"{tmp_path}/r.csv").collect()] == [("1", "a.com"), ("x", None)]


def test_shards(spark, tmp_path):
    with pytest.raises(ValueError):
        corpus_files.shard_paths(spark, str(tmp_path))
    with pytest.raises(ValueError):
        corpus_files.shard_paths(spark, f"{tmp_path}/shard-0000.tmp.parquet")
    one = spark.createDataFrame([("u", "d")], "url string, domain string")
    assert corpus_files.write_shard(one, f"{tmp_path}/shard-0001.parquet") == 1
    with pytest.raises(FileExistsError):
        corpus_files.write_shard(one, f"{tmp_path}/shard-0001.parquet")
    corpus_files.write_shard(one.withColumn("url_port", F.lit(1)), f"{tmp_path}/shard-0000.parquet")
    (tmp_path / "shard-00.parquet").mkdir()
    assert [p[-18:] for p in corpus_files.shard_paths(spark, str(tmp_path))] == ["shard-0000.parquet", "shard-0001.parquet"]
    assert sorted(map(tuple, corpus_files.candidates(spark, str(tmp_path)).select("url", "domain", "url_port").collect()), key=repr) == [("u", "d", 1), ("u", "d", None)]


def test_urls_are_counted_before_they_are_published(spark, tmp_path):
    rows = spark.createDataFrame([('http://a/,"',), ("b",)], "url string")
    assert corpus_files.write_urls(rows, f"{tmp_path}/urls", 2, parts=1) == 2
    with pytest.raises(ValueError):
        corpus_files.write_urls(rows, f"{tmp_path}/urls", 3)
    assert sorted(r["url"] for r in corpus_files.url_lines(spark, f"{tmp_path}/urls").collect()) == ["b", 'http://a/,"']
    assert [p.rpartition("/")[2] for p in files.names(spark, str(tmp_path))] == ["urls"]


def test_ppm_model_file(spark, tmp_path):
    urls = spark.createDataFrame([("http://a.com/x",), ("http://a.com/y",)], "url string")
    own = models.contexts(models.context_model(models.context_counts(urls)))
    ppm_model.save(own, f"{tmp_path}/m.bin", 3, 90, 2, 2)
    want = {(r["ctx_order"], r["ctx_key"]): (r["ctx_total"], [tuple(s) for s in r["symbols"]]) for r in own.collect()}
    assert {(r["ctx_order"], r["ctx_key"]): (r["ctx_total"], [tuple(s) for s in r["symbols"]]) for r in ppm_model.load(spark, f"{tmp_path}/m.bin").collect()} == want
    every = ppm_model.pack([(0, 0, [(b, 1) for b in range(256)])], 3, 90, 1, 1)
    assert len(ppm_model.unpack(every)[1][0][2]) == 256
    good = ppm_model.pack([(0, 0, [(97, 2)])], 3, 90, 1, 1)
    for bad in (b"", b"PPM4" + good[4:], good[:4] + b"\2" + good[5:], good[:5] + b"\4" + good[6:], good[:-1], ppm_model.pack([], 3, 90, 1, 1), ppm_model.pack([(0, 0, [(97, 2)])] * 2, 3, 90, 1, 1), ppm_model.pack([(0, 0, [(97, 0)])], 3, 90, 1, 1), good[:-4] + b"\0\0\0\3"):
        with pytest.raises(ppm_model.ModelError):
            ppm_model.unpack(bad)


@pytest.fixture
def crawl(spark, tmp_path):
    for k in range(4):
        rows = [(f"http://d{i % 5}.com/{k}/{i}", f"D{i % 5}.com", "http", f"/{k}/{i}", None, None) for i in range(40)]
        spark.createDataFrame(rows, "url string, url_host_registered_domain string, url_protocol string, url_path string, url_query string, url_port int").coalesce(1).write.parquet(f"{tmp_path}/crawl/{k}")
    ranked = spark.createDataFrame([(1, "d1.com"), (2, "d2.com"), (2, "d2.com")], "rank int, domain string")
    return [f"{tmp_path}/crawl/{k}" for k in range(4)], ranked


def test_build(spark, tmp_path, crawl):
    sources, ranked = crawl
    plan = collect.Plan(f"{tmp_path}/out", "c1", sources, target=20, per_source=12, quota=10, oversample=1.0, workers=2)
    report = collect.build(spark, plan, ranked)
    assert report["urls"] == 20 and report["domains"] == 2 and report["eligible"] == 20
    got = [r["url"] for r in corpus_files.url_lines(spark, f"{plan.folder}/urls").collect()]
    assert len(set(got)) == 20 and all("//d1" in u or "//d2" in u for u in got)
    state = json.loads(files.read_bytes(spark, plan.state_path))
    assert all(c["rows"] == 12 for c in state["completed"].values())
    again = collect.build(spark, plan, ranked)  # nothing is collected anew
    assert again["files"] == report["files"] and sorted(got) == sorted(r["url"] for r in corpus_files.url_lines(spark, f"{plan.folder}/urls").collect())
    with pytest.raises(collect.StateMismatch):
        collect.build(spark, collect.Plan(plan.folder, "c2", sources, target=20), ranked)


def test_candidates_are_oversampled(spark, tmp_path, crawl, monkeypatch):
    """The first aim is oversample times the target; a crawl file is read once; a second call takes up what the first left."""
    sources, ranked = crawl
    reads, crawl_rows = [], corpus_files.crawl_rows
    monkeypatch.setattr(corpus_files, "crawl_rows", lambda s, path: (reads.append(path), crawl_rows(s, path))[1])
    plan = collect.Plan(f"{tmp_path}/out", "c1", sources, target=10, per_source=12, quota=10, oversample=2.5, workers=1)
    report = collect.build(spark, plan, ranked)
    assert (report["candidates"], report["files"], report["urls"]) == (36, 3, 10)  # 25 candidates take three files of 12
    assert reads == sources[:3]
    names = [p.rpartition("/")[2] for p in files.names(spark, plan.folder)]
    assert names == ["report.json", "shard-0000.parquet", "shard-0001.parquet", "shard-0002.parquet", "state.json", "urls"]
    files.write_bytes(spark, f"{plan.folder}/notes.txt", b"mine")
    collect.reset(spark, plan)
    assert [p.rpartition("/")[2] for p in files.names(spark, plan.folder)] == ["notes.txt"]
    assert collect.load_state(spark, plan).completed == {}
    assert collect.build(spark, plan, ranked)["files"] == 3 and reads == sources[:3] * 2


def test_state_survives_a_stop(spark, tmp_path, crawl, monkeypatch):
    sources, ranked = crawl
    plan = collect.Plan(f"{tmp_path}/out", "c1", sources, target=10, per_source=12, quota=10, oversample=2.5, workers=1)
    save = collect.save_state
    monkeypatch.setattr(collect, "save_state", lambda s, p, state: (_ for _ in ()).throw(KeyboardInterrupt) if len(state.completed) == 2 else save(s, p, state))
    with pytest.raises(KeyboardInterrupt):
        collect.build(spark, plan, ranked)
    assert list(collect.load_state(spark, plan).completed) == ["0"]
    monkeypatch.setattr(collect, "save_state", save)
    assert collect.build(spark, plan, ranked)["files"] == 3


def test_failed_files_can_be_tried_again(spark, tmp_path, crawl):
    sources, ranked = crawl
    missing = [*sources[:1], f"{tmp_path}/crawl/late"]
    plan = collect.Plan(f"{tmp_path}/out", "c", missing, target=20, per_source=100, quota=100, workers=2)
    with pytest.raises(RuntimeError, match="16 of 20"):
        collect.build(spark, plan, ranked)
    assert not files.exists(spark, f"{plan.folder}/urls")
    spark.read.parquet(sources[1]).write.parquet(f"{tmp_path}/crawl/late")
    assert collect.build(spark, plan, ranked)["urls"] == 20


def test_arguments():
    with pytest.raises(ValueError):
        collect.Plan("x", "c", [], target=0)
