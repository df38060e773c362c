import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import near_dups as N
from linkloom.llm.shared import WordHashes

from .conftest import words


def by_hand(rows):
    """doc_id, n_shingles, component_id, kept of each row, from all pairs."""
    def shingle(text):
        w = [x.lower() for x in (text or "").encode().split()]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(d, shingle(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for d, s in sets:
        c = None if d is None else find(d) if s else d
        out.append((d, len(s), c, d is None or c == d))
    return out


def run(df):
    return sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=repr)


def family(rng, size, n, edits):
    """A text and copies of it with some words changed, here and there."""
    base = words(rng, size, 3000).split()
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(docs_of, seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(0, 60)) for _ in range(60)] + [words(rng, 4, 3) for _ in range(20)]
    for size, n, edits in ((150, 40, 12), (40, 30, 3), (8, 10, 1), (600, 20, 60)):
        texts += family(rng, size, n, edits)
    chain = words(rng, 200, 3000).split()  # each is near the next, the ends are far apart
    for k in range(25):
        texts.append(" ".join(chain[k * 4 :] + [f"c{i}" for i in range(k * 4)]))
    texts += texts[:20] * 3
    rng.shuffle(texts)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    assert run(docs_of(rows)) == sorted(by_hand([r[:2] for r in rows]), key=repr)


def test_hub_is_not_the_smallest(docs_of):
    """Copies of a text that are near it but not near each other: the star's centre is one of the copies."""
    rng = random.Random(4)
    base = words(rng, 120, 10**6).split()
    rows = []
    for k in range(12):
        copy = list(base)
        copy[k * 9 + 3] = copy[k * 9 + 6] = f"x{k}"
        rows.append((k, " ".join(copy), "en", "s", 0))
    rows.append((99, " ".join(base), "en", "s", 0))
    got = run(docs_of(rows))
    assert got == sorted(by_hand([r[:2] for r in rows]), key=repr)
    assert {r[2] for r in got} == {0}


@pytest.mark.parametrize("stars", [0, 2])
def test_outlier_in_the_middle_of_a_bucket(docs_of, monkeypatch, stars):
    """The smallest doc_id shares bands with a family but is similar to none: stars around it find nothing, later ones and blocks do."""
    monkeypatch.setattr(N, "STARS", stars)
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(12)
    texts = []
    for n in (30, 9):
        base = words(rng, 160, 10**6).split()
        outlier = base[:115] + words(rng, 45, 10**6).split()
        texts.append(" ".join(outlier))
        for _ in range(n):
            copy = list(base)
            copy[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    assert run(docs_of(rows)) == sorted(by_hand([r[:2] for r in rows]), key=repr)


def test_repeated_rows_count_once(docs_of, monkeypatch):
    rng = random.Random(13)
    base = words(rng, 100, 10**6)
    seen = []
    likely, confirmed = N.likely, N.confirmed
    monkeypatch.setattr(N, "likely", lambda pairs, classes: (out := likely(pairs, classes), seen.append((classes.count(), out.count())))[0])
    monkeypatch.setattr(N, "confirmed", lambda pairs, sets: (seen.append((pairs.count(), sets.count())), confirmed(pairs, sets))[1])
    counts = []
    for times in (1, 5, 20):
        seen.clear()
        rows = [(1, base, "en", "s", 0), (2, base + " end", "en", "s", 0), (3, words(rng, 50), "en", "s", 0)] * times
        got = run(docs_of(rows))
        assert got == sorted([(1, 96, 1, True), (2, 97, 1, False), (3, 46, 3, True)] * times, key=repr)
        counts.append(list(seen))
    assert counts[0] == counts[1] == counts[2]


def test_odd_rows(odd):
    assert run(odd) == sorted(by_hand([(r["doc_id"], r["text"]) for r in odd.collect()]), key=repr)


def test_empty(empty):
    assert run(empty) == []


def test_first_of_each(odd):
    kept = N.first_of_each(odd)
    assert kept.columns == odd.columns
    assert 7 not in [r["doc_id"] for r in kept.collect()] and {1, 2, 3, 6} <= {r["doc_id"] for r in kept.collect()}


def test_first_of_each_of_repeated_and_null_ids(docs_of):
    rng = random.Random(8)
    a, b, c, d, e, f = (words(rng, 40, 10**6) for _ in range(6))
    near = a + " end"
    rows = [(1, a), (2, a), (2, b), (3, near), (4, c), (4, c), (4, c.upper()), (None, c), (None, d), (None, d), (5, e), (5, e), (None, near), (6, ""), (6, ""), (None, None), (7, f)]
    kept = [(1, a), (2, b), (None, d), (5, e), (6, ""), (6, ""), (None, None), (7, f)]
    got = [(r["doc_id"], r["text"]) for r in N.first_of_each(docs_of([(k, t, "en", "s", 0) for k, t in rows])).collect()]
    assert sorted((x for x in got if x[0] != 4), key=repr) == sorted(kept, key=repr)
    assert [x[1].lower() for x in got if x[0] == 4] == [c]
    assert len([x for x in N.first_of_each(docs_of([(k, t, "en", "s", 0) for k, t in [(1, a), (2, a), (2, b), (3, near)]])).collect()]) == 2


def test_components(spark):
    rng = random.Random(9)
    for _ in range(3):
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
        edges = [(a, b) for a, b in edges if a != b]
        root = {x: x for e in edges for x in e}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root if find(x) != x}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    order = N.probes()
    for n in (3, 20, 100, 1000):
        close = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, n + n // 2, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[n // 2 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            close.append((N.signature(a, order) == N.signature(b, order)).mean() - true)
        assert abs(np.mean(close)) < 0.04


def test_short_text_is_one_shingle():
    c = WordHashes()
    assert [len(N.shingles(t, c)) for t in (None, "", " \n", "a", "a b c d", "a b c d e", "a b c d e f", "a a a a a a")] == [0, 0, 0, 1, 1, 1, 2, 1]
    assert N.shingles("A b C d", c).tolist() == N.shingles("a B c D", c).tolist()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in N.op3_near_dups(spark, sf_dir).collect()), key=repr)
    assert got == sorted(by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", F.col("text")).collect()]), key=repr)
