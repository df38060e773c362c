import random
import time

import pytest

from linkloom.llm import decontam as D

from .conftest import words

ITEMS = "item_id long, text string, doc_id long"


def brute_tiles(a, b, least):
    used_a, used_b, out = [0] * len(a), [0] * len(b), []
    while True:
        found, best = [], least
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and b[j + k] >= 0 and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    found, best = [(i, j, k)], k
                elif k == best:
                    found.append((i, j, k))
        if not found:
            return out
        for i, j, k in found:
            if not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                out.append((i, j, k))
                used_a[i : i + k] = used_b[j : j + k] = [1] * k


def test_tiles():
    rng = random.Random(1)
    for _ in range(1500):
        v = rng.choice([2, 3, 6])
        a = [rng.randrange(v) for _ in range(rng.randrange(25))]
        b = [rng.randrange(-1 if v > 2 else 0, v) for _ in range(rng.randrange(40))]
        least = rng.choice([1, 2, 3, 4])
        got, want = D.tile(a, b, least), brute_tiles(a, b, least)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        for i, j, k in got:
            assert a[i : i + k] == b[j : j + k] and k >= least
        assert sum(t[2] for t in got) == len({i + d for i, _, k in got for d in range(k)}) == len({j + d for _, j, k in got for d in range(k)})


def by_hand(docs, items, least=4, threshold=0.6):
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            names = {}
            a, b = ([names.setdefault(w, len(names)) for w in D.tokens(t)] for t in (item, text))
            if a and b:
                n = min(least, len(a))
                covered = sum(t[2] for t in brute_tiles(a, b, n))
                if covered >= threshold * len(a):
                    out.append((doc_id, item_id, round(covered / len(a), 9)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(2)
    items = [(k, words(rng, rng.randrange(15, 40), 300)) for k in range(12)] + [(50, "just three words"), (51, ""), (52, None), (53, "!!"), (None, "an item without an id but with words enough")]
    docs = [(k, words(rng, rng.randrange(200), 300)) for k in range(40)]
    for k, (_, item) in enumerate(items[:12]):
        w = item.split()
        half = len(w) // 2
        docs += [(100 + k, f"{words(rng, 30)} {item.upper()}! {words(rng, 30)}"), (200 + k, " ".join(w[half:] + words(rng, 9).split() + w[:half])), (300 + k, " ".join(w[:half])), (400 + k, " ".join(x + "," if i % 3 else x for i, x in enumerate(w)))]
        docs.append((500 + k, " ".join(rng.sample(w, len(w)))))
    docs += [(600, "so just three words"), (601, "three words just"), (602, None), (603, ""), (None, items[0][1]), (604, items[1][1]), (604, items[1][1]), (605, "an item without an id but with words enough")]
    return docs, items


def test_against_brute_force(spark, docs_of, monkeypatch):
    docs, items = cases()
    df = docs_of([(d, t, "en", "s", 0) for d, t in docs])
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    want = by_hand(docs, items)
    assert {k for k, *_ in want if k is not None} >= {*range(100, 112), *range(200, 212), *range(400, 412), 600, 604, 605}
    assert not {k for k, *_ in want if k is not None} & {*range(300, 312), 601}
    run = lambda: sorted(((r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in D.contaminated(df, bench).collect()), key=repr)
    assert run() == want
    one_each = D.item_blocks
    monkeypatch.setattr(D, "item_blocks", lambda b: one_each(b, 100))  # in several blocks
    assert run() == want
    kept = D.clean_documents(df, bench)
    flagged = {t for d, t in docs if any(k == d for k, *_ in want)}
    assert sorted(map(repr, (r["text"] for r in kept.collect()))) == sorted(repr(t) for _, t in docs if t not in flagged)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "The same text of more, than five words.", 1)], ITEMS)
    assert sorted(r["doc_id"] for r in D.contaminated(odd, bench).collect()) == [6, 6, 7]
    assert D.clean_documents(odd, bench).columns == odd.columns
    assert D.clean_documents(odd, bench).count() == odd.count() - 3
    assert D.contaminated(empty, bench).count() == 0
    assert D.contaminated(odd, spark.createDataFrame([], ITEMS)).count() == 0
    assert D.clean_documents(odd, spark.createDataFrame([], ITEMS)).count() == odd.count()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_short_items(n):
    item = " ".join("abcde"[:n])
    i = D.Items([(1, item)], 4, 0.6)
    assert i.matches(f"x {item} y") == [(1, 1.0, 1, n)]
    assert i.matches("x y z") == []


def test_scripts_without_spaces():
    item = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    got = D.Items([(1, item), (2, "ภาษาไทยเขียนติดกันไม่เว้นวรรค")], 4, 0.6).matches(f"前面的文字，{item[10:]}。中间{item[:10]}后面")
    assert [m[0] for m in got] == [1] and got[0][2] == 2
    assert D.Items([(2, "ภาษาไทยเขียนติดกันไม่เว้นวรรค")], 4, 0.6).matches("กขค ภาษาไทยเขียนติดกันไม่เว้นวรรค abc")
    assert D.tokens("Été, l’été") == ["Été,".encode()[:-1], "l’été".encode()]


@pytest.mark.parametrize("text, item", [("a " * 20_000, "a " * 40), ("a a a a x " * 4_000, "a " * 60), ("a b " * 10_000 + "c", "a b " * 30 + "c d"), ("a b c d " * 5_000, "d c b a " * 10)])
def test_long_and_repetitive_texts(text, item):
    began = time.time()
    got = D.Items([(k, item) for k in range(5)], 4, 0.6).matches(text)
    assert time.time() - began < 20
    a, b = ([{"a": 0, "b": 1, "c": 2, "d": 3, "x": -1}[w] for w in t.split()] for t in (item, text[:2000] + text[-400:]))
    assert bool(got) == (sum(t[2] for t in brute_tiles(a, b, 4)) >= 0.6 * len(a))


def test_near_matches_in_documents(spark, sf_dir):
    """Every item and a sample of documents that hold parts of it, changed, against brute force: what the query gives for reordered and partial passages."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:12]
    rng, docs = random.Random(21), []
    for k, (_, text) in enumerate(items):
        w = text.split()
        for j in range(6):
            cut, v = rng.randrange(1, len(w)), list(w)
            for _ in range(rng.randrange(len(w) // 2)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(99)}"
            docs.append((k * 10 + j, words(rng, 20) + " " + " ".join(v[cut:] + ["between"] + v[:cut]) + " " + words(rng, 20)))
    got = sorted(((d, m[0], round(m[1], 9)) for d, t in docs for m in D.Items(items, 4, 0.6).matches(t)), key=repr)
    assert got == by_hand(docs, items) and 0 < len(got) < len(docs)


def test_query(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"]) for r in D.op9_decontamination(spark, sf_dir).collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x.split() and f" {' '.join(x.split())} " in f" {' '.join((t or '').split())} "}
    assert whole <= got and len(got) < 0.2 * len(docs)
