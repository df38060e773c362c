import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from linkloom.llm import shared as S

REPO = Path(__file__).resolve().parents[2]


def test_words():
    assert S.lower_words(None) == [] == S.lower_words(" \t\n\x0b\f\r")
    assert S.lower_words("Ab\xa0C\x85d É\x1cx") == ["ab\xa0c\x85d".encode(), "É\x1cx".encode()]


def test_ngrams_differ_by_order_and_place():
    h = S.word_hashes([b"a", b"b", b"a", b"b", b"c"], S.WordHashes())
    two = S.ngram_hashes(h, 2)
    assert two[0] == two[2] and len(set(two.tolist())) == 3
    assert len(S.ngram_hashes(h, 6)) == 0
    assert S.ngram_hashes(h[:1], 1)[0] != S.ngram_hashes(h[:2], 2)[0]
    assert len(np.unique(S.mixed(np.arange(10_000, dtype=np.uint64)))) == 10_000


def test_memory_of_words_is_bounded():
    c = S.WordHashes()
    values = [c[str(k).encode()] for k in range(250_000)]
    assert len(c) <= 200_000 and c[b"3"] == values[3]


def test_by_size():
    assert list(S.by_size([], 3)) == []
    assert list(S.by_size(["ab", None, "c", "", "dddd", "e"], 3)) == [(0, 3), (3, 5), (5, 6)]


def test_folders(spark):
    df = S.written(spark.range(5), "five")
    path = S.MADE[-1]
    assert path.startswith(S.shared_dir(spark)) and df.count() == 5
    S.clean(spark)
    assert not Path(path.removeprefix("file://")).exists() and not S.MADE


def test_discard(spark):
    since = len(S.MADE)
    kept, gone = S.written(spark.range(3), "two-words"), S.written(spark.range(4), "gone")
    S.discard(spark, since, "two-words")
    assert kept.count() == 3 and len(S.MADE) == since + 1
    assert not Path(gone.inputFiles()[0].removeprefix("file://")).exists()


def test_the_sessions_folder_is_taken():
    from types import SimpleNamespace

    session = lambda at, master="local[2]": SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": at, "spark.master": master}[key] or default))
    assert S.shared_dir(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        S.shared_dir(session(None, "yarn"))
    own = S.shared_dir(session(None))
    assert own.startswith("file:///") and own == S.shared_dir(session(""))


def test_unused_names():
    assert S.unused(["a", "B", "b_"], "a", "b", "c", "c") == ["a_", "b__", "c", "c_"]


@pytest.mark.parametrize("missing", [False, True])
def test_the_rest_stands_alone(tmp_path, missing):
    """Without this subpackage and the pipeline the entry still imports, and has the other queries."""
    for p in REPO.iterdir():
        if p.name not in ("linkloom", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "linkloom").mkdir()
    for p in (REPO / "linkloom").iterdir():
        if not (missing and p.name == "llm"):
            (tmp_path / "linkloom" / p.name).symlink_to(p)
    if not missing:
        (tmp_path / "corpus_pipeline.py").symlink_to(REPO / "corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'op3_near_dups' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, *there = out.stdout.split()
    assert int(n) > 40 and there == ([str(not missing)] * 2 + ["True"])


@pytest.mark.parametrize("module", ["linkloom.llm.registry", "corpus_pipeline", "xxhash"])
def test_the_rest_stands_alone_if_an_import_fails(module):
    """A library that the operators need is missing: the other queries are still there."""
    code = f"import sys; sys.modules['{module}'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, 'op3_near_dups' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, operator, oracles = out.stdout.split()
    assert int(n) > 40 and (pipeline, operator, oracles) == (str(module == "linkloom.llm.registry"), str(module == "corpus_pipeline"), "True")
