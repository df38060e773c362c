import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing as M


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_hand(rows, rows_of=None):
    """The mix, one row after another: (doc_id, size, source_size, target, taken)."""
    sizes, groups = defaultdict(int), defaultdict(list)
    for doc_id, text, source in rows:
        sizes[source] += words(text)
        content = hashlib.md5((text or "").encode()).hexdigest()
        key = int(hashlib.md5(f"0|{'' if doc_id is None else doc_id}|{content}".encode()).hexdigest()[:15], 16)
        groups[source].append((key, doc_id is not None, doc_id or 0, words(text), doc_id))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:  # shares by weight; what is over a cap is shared again
        left = total - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    out = []
    for s, members in groups.items():
        left, cycle = math.floor(target[s] + 1e-9), sorted(members, key=lambda m: m[:4])
        taken = [0] * len(cycle)
        while left > 0 and sizes[s]:
            for i, m in enumerate(cycle):
                n = min(m[3], left)
                taken[i], left = taken[i] + n, left - n
        out += [(m[4], m[3], sizes[s], target[s], t) for m, t in zip(cycle, taken, strict=True)]
    return out


def same(got, want):
    key = lambda r: (repr(r[0]), *r[1:])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3])


def run(df, **how):
    return [tuple(r) for r in M.mix(df.select("doc_id", "source", "text"), M.word_count(F.col("text")), **how).select("doc_id", "size", "source_size", "target", "taken").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs_of, seed):
    rng = random.Random(seed)
    rows = [(k, "x " * rng.randrange(0, 40), "en", rng.choice(["b", "b", "b", "b", "a", "c", None, "é", "Z"]), 0) for k in range(600)]
    want = by_hand([(r[0], r[1], r[3]) for r in rows])
    for ranges in (1, 50, 4096):
        got = run(docs_of(rows), rows_per_range=ranges)
        same(got, want)
    assert all(r[4] <= 2 * r[1] for r in got)


def test_odd_rows(odd):
    same(run(odd), by_hand([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]))
    both = M.mix(odd, M.word_count(F.col("text")))
    assert both.columns == [*odd.columns, "size_", "source_size", "target", "taken_"]
    assert sorted(map(repr, both.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))  # the caller's columns keep their values
    same([tuple(r) for r in both.select("doc_id", "size_", "source_size", "target", "taken_").collect()], by_hand([(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_one_id_for_a_third_of_the_rows(docs_of, doc_id):
    rng = random.Random(5)
    rows = [(k if k % 3 else doc_id, f"t{k} " * rng.randrange(9), "en", rng.choice("aab"), 0) for k in range(900)]
    same(run(docs_of(rows), rows_per_range=20), by_hand([(r[0], r[1], r[3]) for r in rows]))
    own, names = M.sized(docs_of(rows), M.word_count(F.col("text")))
    keys = own.filter(F.col("doc_id").eqNullSafe(F.lit(doc_id))).select((F.col(names[1]) / (1 << 50)).cast("int").alias("r")).groupBy("r").count()
    assert keys.agg(F.max("count")).first()[0] < 60  # texts spread them


def test_runs_of_ranges(docs_of, monkeypatch):
    monkeypatch.setattr(M, "RANGES", 3)
    rows = [(k, f"t{k} " * (k % 11), "en", "aab"[k % 3], 0) for k in range(400)]
    same(run(docs_of(rows), rows_per_range=5), by_hand([(r[0], r[1], r[3]) for r in rows]))


def test_empty(empty):
    assert run(empty) == []
    assert M.mixed_documents(empty).count() == 0


def test_documents(docs_of, odd):
    rows = [(k, f" a{k}\tb  c\n", "en", "xyz"[k % 3], 9) for k in range(90)]
    out = M.mixed_documents(docs_of(rows)).collect()
    taken = {r[0]: r[4] for r in run(docs_of(rows))}
    got = defaultdict(int)
    for r in out:
        got[r["doc_id"]] += words(r["text"])
        assert rows[r["doc_id"]][1].startswith(r["text"])
        assert r["n_chars"] == (9 if r["text"] == rows[r["doc_id"]][1] else len(r["text"]))
    assert got == {k: n for k, n in taken.items() if n}
    mixed = M.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert {(r["size"], r["taken"], r["score"]) for r in mixed.collect()} == {("x", 1, 2.0)}


def test_reruns_agree(docs_of):
    rows = [(k, "x " * (k % 17), "en", "ab"[k % 2], 0) for k in range(300)]
    assert sorted(run(docs_of(rows))) == sorted(run(docs_of(rows[::-1]).repartition(7)))
