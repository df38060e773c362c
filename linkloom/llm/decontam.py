"""Benchmark decontamination (9): greedy string tiling of test items in documents.

Documents and items are joined on shared seeds, runs of ``min_match`` tokens. For a pair whose seeds could reach the
threshold, the longest matches are marked again and again, none overlapping another, found by running Karp-Rabin hashes of
falling length. A pair counts if its tiles cover enough of the item, in whatever order they come.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import worker_cache

#: A-Z to small letters; every ASCII sign that is no letter or digit to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BASE, MOD = 1_000_003, (1 << 61) - 1
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


#: Characters of scripts that write no spaces, each of them a token: from Thai to Tibetan, Myanmar, Khmer, and what is written in China and Japan.
SOLID = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3040-\u312f\u31a0-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SIGNS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]+")


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case; in scripts without spaces each character. Null: none."""
    if not text:
        return []
    if not text.isascii() and SOLID.search(text):
        text = SOLID.sub(r" \g<0> ", SIGNS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def _windows(seq: list, taken: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """(start, running Karp-Rabin hash) of every n-token window without a taken token or a gap (negative token)."""
    high, value, run = pow(BASE, n - 1, MOD), 0, 0
    for i, x in enumerate(seq):
        if taken[i] or x < 0:
            value = run = 0
            continue
        if run >= n:
            value -= (seq[i - n] + 1) * high
        value, run = (value * BASE + x + 1) % MOD, run + 1
        if run >= n:
            yield i - n + 1, value


def tile(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length): maximal matches, the longest first, none overlapping in either.

    Tokens are numbers; a negative one in the text matches nothing.
    """
    used_a, used_b, tiles = [False] * len(item), [False] * len(text), []
    if not item or not text or min_match < 1:
        return tiles
    n = max(min_match, min(len(item), len(text)))
    while True:
        places = defaultdict(list)
        for j, h in _windows(text, used_b, n):
            places[h].append(j)
        found, longer = [], 0
        for i, h in _windows(item, used_a, n) if places else ():
            for j in places.get(h, ()):
                if item[i : i + n] != text[j : j + n]:
                    continue
                k = n
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > 2 * n:
                    longer = max(longer, k)
                found.append((k, i, j))
        if longer:  # a match so long that it must be marked first: again, from its length
            n = longer
            continue
        if found:  # the longest are marked; shorter ones are found anew in what is left
            best = max(t[0] for t in found)
            for k, i, j in found:
                if k == best and not any(used_a[i : i + k]) and not any(used_b[j : j + k]):
                    tiles.append((i, j, k))
                    used_a[i : i + k], used_b[j : j + k] = [True] * k, [True] * k
            continue
        if n == min_match:
            return tiles
        n = max(min_match, n // 2)


class Items:
    """Test items with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], min_match: int, threshold: float):
        self.min_match, self.threshold, self.vocabulary = min_match, threshold, {}
        place = self.vocabulary.setdefault
        self.ids, self.items = [], []
        for item_id, text in rows:
            t = [place(w, len(self.vocabulary)) for w in tokens(text)]
            if t:
                self.ids.append(item_id)
                self.items.append(t)
        #: By seed length (items shorter than min_match are one seed each): sorted hashes, where each one's places begin, items, places.
        self.index = {}
        by_length = defaultdict(list)
        for k, t in enumerate(self.items):
            by_length[min(min_match, len(t))].append(k)
        for n, ks in by_length.items():
            h = np.concatenate([self._hashes(np.array(self.items[k], np.int64), n)[0] for k in ks])
            item = np.repeat(np.array(ks), [len(self.items[k]) - n + 1 for k in ks])
            at = np.concatenate([np.arange(len(self.items[k]) - n + 1) for k in ks])
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.index[n] = keys, np.append(first, len(h)), item[order], at[order]

    @staticmethod
    def _hashes(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-token windows without a gap, and where they start."""
        known = np.flatnonzero(np.convolve(x >= 0, np.ones(n, int), "valid") == n) if len(x) >= n else np.empty(0, int)
        h = np.zeros(len(known), np.uint64)
        for k in range(n):
            h = (h ^ (x[known + k].astype(np.uint64) + np.uint64(1))) * np.uint64(MULTIPLIERS[k % 4])
            h ^= h >> np.uint64(29)
        return h, known

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, covered tokens) of every item that the text covers to the threshold."""
        words = tokens(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        x = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for n, (keys, first, item, at) in self.index.items():
            h, start = self._hashes(x, n)
            if not len(h):
                continue
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == h)
            if not len(hit):
                continue
            # Postings are read once for each distinct seed of the text, however often it occurs there.
            seed, occurrence, start = *np.unique(k[hit], return_inverse=True), start[hit]
            count = first[seed + 1] - first[seed]
            post = np.arange(int(count.sum())) + np.repeat(first[seed] - (np.cumsum(count) - count), count)
            items, places, seeds = item[post], at[post], np.repeat(np.arange(len(seed)), count)
            order = np.argsort(items, kind="stable")
            items, places, seeds = items[order], places[order], seeds[order]
            cuts = np.flatnonzero(np.diff(items)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(items)], strict=True):
                own = self.items[int(items[a])]
                covered = np.zeros(len(own), bool)
                for d in range(n):
                    covered[places[a:b] + d] = True
                if covered.sum() < self.threshold * len(own):
                    continue  # tiles lie within shared seeds, so they can't reach the threshold
                shared = np.zeros(len(seed), bool)
                shared[seeds[a:b]] = True
                starts, near = start[shared[occurrence]], np.zeros(len(x), bool)
                for d in range(n):
                    near[starts + d] = True
                tiles = tile(own, self._near(x, near), n)
                total = sum(t[2] for t in tiles)
                if total >= self.threshold * len(own):
                    out.append((self.ids[int(items[a])], total / len(own), len(tiles), total))
        return out

    @staticmethod
    def _near(x: np.ndarray, near: np.ndarray) -> list[int]:
        """The tokens within shared seeds, with a gap where others were left out."""
        at = np.flatnonzero(near)
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        return np.insert(x[at], gaps, -1).tolist()


def _items(broadcast: Broadcast, uid: str, min_match: int, threshold: float) -> Items:
    cache = worker_cache("decontam")
    if cache.get("decontam-uid") != uid:
        cache["decontam-items"], cache["decontam-uid"] = Items(broadcast.value, min_match, threshold), uid
    return cache["decontam-items"]


def item_blocks(benchmark: DataFrame, most_chars: int = 32 << 20) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark (item_id, text) as blocks of at most about ``most_chars`` characters, read one after another."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= most_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


PAIRS = "doc_id long, item_id long, coverage double, n_tiles int, n_tokens int"


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.6) -> DataFrame:
    """One row for each document and test item whose tiles cover at least ``threshold`` of the item's tokens.

    The items are a stated query set: they are sent to the executors in blocks of bounded size, and each block meets all
    documents in one pass without a shuffle. Seeds are compared by hash, tiles by their tokens. Items of fewer than
    ``min_match`` tokens match as a whole, items without tokens never. Of matches that are equally long the first by place in
    the item is marked first. Null and empty texts have no rows; very long ones are searched whole; a null doc_id or item_id
    is carried along, repeated rows give repeated rows. Empty tables give an empty result. Other columns aren't read.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in item_blocks(benchmark):
        sent, uid = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, uid: str = uid) -> Iterator[pa.RecordBatch]:
            items = _items(sent, uid, min_match, threshold)
            for batch in batches:
                got = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in items.matches(t)]
                cols = zip(*got, strict=True) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], [x.split()[0] for x in PAIRS.split(", ")])

        part = rows.mapInArrow(search, PAIRS)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], PAIRS) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.6) -> DataFrame:
    """docs(text, ...) without the rows that contain a test item, as contaminated() finds them; no shuffle.

    Null and empty texts stay, each repeated row is judged, and all columns keep their values, whatever their names.
    """
    spark = docs.sparkSession
    for block in item_blocks(benchmark):
        sent, uid, at = spark.sparkContext.broadcast(block), uuid.uuid4().hex, docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, uid: str = uid, at: int = at) -> Iterator[pa.RecordBatch]:
            items = _items(sent, uid, min_match, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
