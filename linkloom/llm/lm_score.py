"""LM scoring (10): a weighted backoff automaton over an n-gram model that learns from the whole corpus.

States are contexts, the last words of a text as far as training has them: the empty one (root), words, pairs of words. A
state's arc for a word that followed it in training carries that word's smoothed probability; for any other word a failure
arc leads to the next shorter context at the cost of the state's backoff weight, and the root has an arc for every word.
Smoothing is by Dirichlet priors from the lower order,

    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),    p(w | h) = (c(h w) + prior * p(w | h')) / (c(h) + prior),

so the backoff weight of h is prior / (c(h) + prior), and the probabilities of all words after h sum to one.

No task holds the model. Texts are dealt to blocks. Order by order, a block asks for the counts of its own n-grams, the
counts are summed by hash ranges over all blocks, and each block gets back those it asked for. It asks only for
n-grams that other blocks can have as well, those whose shorter parts both are elsewhere; of others its own count is all. At last
each block builds the part of the automaton that its texts can reach, and walks it from left to right, many texts at a time: the
state is carried from word to word, along an arc or, while there is none, along failure arcs. There are as many hash ranges as the corpus has
RANGE_TOKENS tokens, so a task holds a block or a range whatever the corpus and its vocabulary; an n-gram that every block
asks for is one row a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WordHashes, lower_words, mixed, new_folder, width, word_hashes, worker_cache, written

PRIORS = (300.0, 10.0)  # of pairs, of triples
BLOCK_TOKENS = 400_000
RANGE_TOKENS = 250_000  # tokens of the corpus a hash range: a block never asks for more n-grams of an order than it has tokens
RANGES_A_TASK, BLOCKS_A_TASK = 4, 8
LANE = 256  # tokens
#: Tokens with white space, which no word has.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" begin"))
RARE = 0xFFFF

BLOCK = "block long, n_tokens long, doc_ids binary, no_id binary, train binary, lengths binary, words binary, tokens binary, rare binary"


def _pack(block: int, rows: list[tuple[int | None, bool, np.ndarray]]) -> tuple:
    """A block: its distinct word hashes, the most frequent first, and its texts as places among them, in two bytes where they fit."""
    flat = np.concatenate([np.append(r[2], END) for r in rows])
    words, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    tokens = place[inverse]
    ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
    return (
        block, len(flat), ids.tobytes(), np.array([r[0] is None for r in rows]).tobytes(), np.array([r[1] for r in rows]).tobytes(), np.array([len(r[2]) + 1 for r in rows], np.uint32).tobytes(),
        words[order].tobytes(), np.minimum(tokens, RARE).astype(np.uint16).tobytes(), tokens[tokens >= RARE].tobytes(),
    )


def blocks(docs: DataFrame, learn: Column, block_tokens: int) -> DataFrame:
    """docs as blocks of whole texts with about ``block_tokens`` tokens; the text's end is a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = worker_cache("lm").setdefault("lm-words", WordHashes())
        names = [x.split()[0] for x in BLOCK.split(", ")]
        first, n, rows, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                for doc_id, train, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    h = word_hashes(lower_words(text), cache)
                    rows.append((doc_id, bool(train), h))
                    size += len(h) + 1
                    if size >= block_tokens:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _pack(first + n, rows)], names)
                        n, rows, size = n + 1, [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _pack(first + n, rows)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("train"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK)


class Grams:
    """A block's distinct n-grams of one order.

    ``at``: the n-gram that ends at each token, -1 where the text's begin is too near. ``keys``: their hashes, equal in all
    blocks. ``left``, ``right``: each one's n-gram of the order below without its last word, and without its first.
    ``own``: its count in the block's training texts; ``count``: in all of them.
    """

    def __init__(self, at: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray, train: np.ndarray):
        self.at, self.keys, self.left, self.right = at, keys, left, right
        self.own = np.bincount(at[train & (at >= 0)], minlength=len(keys))
        self.count = self.own.copy()
        self.elsewhere = np.ones(len(keys), bool)  # whether other blocks have it


class Block:
    """A block's tokens, and its n-grams as far as they have been built."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.no_id, self.train = np.frombuffer(row["no_id"], bool), np.frombuffer(row["train"], bool)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.uint16).astype(np.int64)
        self.tokens[self.tokens == RARE] = np.frombuffer(row["rare"], np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(self.train, self.lengths)
        none = np.zeros(len(self.words), np.int64)
        self.orders = [Grams(self.tokens, mixed(self.words), none, none, self.trained)]

    def extend(self) -> None:
        """Builds the next order. A text's begin is a word that only contexts have, numbered after the others."""
        below, n, begin = self.orders[-1], len(self.orders), len(self.words)
        previous = np.roll(below.at, 1).astype(np.int64)
        if n == 1:
            previous[self.starts] = begin
        else:
            previous[self.starts] = -1
        there = np.flatnonzero(previous >= 0)
        code, at = np.unique(previous[there] * np.int64(begin + 1) + self.tokens[there], return_inverse=True)
        at = at.astype(np.int32)
        full = np.full(len(self.tokens), -1, np.int32)
        full[there] = at
        left, word = (code // (begin + 1)).astype(np.int32), (code % (begin + 1)).astype(np.int32)
        parents = np.append(below.keys, mixed(np.array([BEGIN]))) if n == 1 else below.keys
        keys = mixed(parents[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(self.words[word] ^ np.uint64(n)))
        right = np.empty(len(code), np.int32)
        right[at] = below.at[there]
        self.orders.append(Grams(full, keys, left, right, self.trained))

    def open(self) -> np.ndarray:
        """Places of the last order's n-grams that other blocks could have too, in the order of their keys."""
        top = self.orders[-1]
        if len(self.orders) == 1:
            asked = np.arange(len(top.keys))
        else:
            seen = self.orders[-2].elsewhere
            asked = np.flatnonzero(np.append(seen, True)[top.left] & seen[top.right])  # the begin of a text is in every block
        return asked[np.argsort(top.keys[asked], kind="stable")]

    def answered(self, answers: np.ndarray) -> None:
        """Takes the answers for open(): twice the count, and one if more than one block asked."""
        top, asked = self.orders[-1], self.open()
        top.count[asked] = answers >> 1
        top.elsewhere = np.zeros(len(top.keys), bool)
        top.elsewhere[asked] = answers & 1


class Automaton:
    """The states and arcs that a block's texts can reach.

    A state is a context of n words that training has, the root that of none. Its arc for a word is the n-gram of n + 1 words
    that ends there, numbered as in the block's order n, and exists if training has that n-gram; the arc leads to the longest
    context that ends with it. A state but the root has a failure arc to the context without its first word. ``arcs`` and
    ``failures`` are by order the weights of the arcs, and of the failure arcs of the states that they leave.
    """

    def __init__(self, block: Block, texts: int, total: int, distinct: int, priors: Sequence[float]):
        words = block.orders[0]
        p = (words.count + 0.5) / (total + 0.5 * (distinct + 1))
        self.arcs, self.failures, self.exists, self.known = [np.log10(p)], [np.zeros(len(p))], [np.ones(len(p), bool)], words.count > 0
        for n, prior in enumerate(priors[: len(block.orders) - 1], 1):
            grams, below = block.orders[n], block.orders[n - 1]
            context = (np.append(below.count, texts) if n == 1 else below.count)[grams.left].astype(float)
            p = (grams.count + prior * p[grams.right]) / (context + prior)
            self.arcs.append(np.log10(p))
            self.failures.append(np.log10(prior / (context + prior)))
            self.exists.append(grams.count > 0)

    def traverse(self, block: Block) -> np.ndarray:
        """The weight of each step of all texts, read from left to right with the state carried along.

        Texts are cut into lanes of LANE tokens, and all lanes of the block make their t-th step together. A lane that begins
        a text starts in the state of its begin; one that goes on with a text starts at the root, as many tokens earlier as
        the longest context has, which leads to the same state. With a lane's place, the length of its context tells its state.
        """
        longest, tokens = len(self.arcs) - 1, block.tokens
        lanes = -(-block.lengths // LANE)
        part = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lead = np.where(part > 0, longest, 0)
        begin = np.repeat(block.starts, lanes) + part * LANE - lead
        size = np.minimum(np.repeat(block.starts + block.lengths, lanes), begin + lead + LANE) - begin
        order = np.argsort(-size, kind="stable")
        begin, size, lead = begin[order], size[order], lead[order]
        state = np.where(part[order] > 0, 0, min(1, longest))
        alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # lanes with a t-th step
        steps = np.zeros(len(tokens))
        for t, m in enumerate(alive.tolist()):
            at, now, cost = begin[:m] + t, state[:m], np.zeros(m)
            after = np.zeros(m, np.int64)
            for n in range(longest, 0, -1):
                here = np.flatnonzero(now == n)
                gram = block.orders[n].at[at[here]]
                there = self.exists[n][gram]
                cost[here] += np.where(there, self.arcs[n][gram], self.failures[n][gram])
                after[here[there]] = min(n + 1, longest)
                now[here] = np.where(there, -1, n - 1)
            here = np.flatnonzero(now == 0)
            word = tokens[at[here]]
            cost[here] += self.arcs[0][word]
            if longest:
                after[here] = self.known[word]
            state[:m] = after
            own = t >= lead[:m]
            steps[at[own]] = cost[own]
        return steps


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as all their lowest bytes, then all their second bytes, and so on: small numbers then compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of the hash each key falls in; sorted keys give sorted ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _answer_file(folder: str, order: int, block: int) -> str:
    return f"{folder}/counts-{order}/{block:016x}"


def _rebuilt(row: dict, folder: str, orders: int) -> Block:
    """A block with the counts of its first orders."""
    from pyarrow import fs

    b = Block(row)
    for n in range(1, orders + 1):
        if n > 1:
            b.extend()
        store, name = fs.FileSystem.from_uri(_answer_file(folder, n, row["block"]))
        data = b""
        if store.get_file_info(name).type == fs.FileType.File:
            with store.open_input_stream(name, compression=None) as f:
                data = zlib.decompress(f.read())
        b.answered(unplanes(data).astype(np.int64))
    return b


def _count_order(packed: DataFrame, folder: str, order: int, n_blocks: int, n_tokens: int) -> tuple[int, int]:
    """Counts the n-grams of one order and leaves each block's answers in a file; returns how many there are, and how many distinct.

    Both shuffles have as many partitions as the corpus asks for, so that the largest task stays as it is when the corpus grows.
    """
    ranges, least = 1 + n_tokens // RANGE_TOKENS, width(packed.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _rebuilt(row, folder, order - 1) if order > 1 else Block(row)
                if order > 1:
                    b.extend()
                top, asked = b.orders[-1], b.open()
                keys, own = top.keys[asked], top.own[asked]
                found, first = np.unique(_range(keys, ranges), return_index=True)
                cuts = np.append(first, len(keys)).tolist()
                for k in range(0, len(found), 1000):
                    part = list(zip(cuts[k : k + 1000], cuts[k + 1 : k + 1001], strict=False))
                    sent = [pa.array([planes(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in part], pa.binary()), pa.array([planes(own[x:y]) for x, y in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 1000], pa.int64()), pa.array([row["block"]] * len(part), pa.int64()), *sent], ["range", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        n = np.array([len(x.as_buffer()) // 8 for x in table.column("keys")])
        keys = np.concatenate([np.cumsum(unplanes(x.as_buffer()), dtype=np.uint64) for x in table.column("keys")])
        counts = np.concatenate([unplanes(x.as_buffer()) for x in table.column("counts")]).astype(np.int64)
        every, inverse = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, inverse, counts)
        answers = sums << 1 | (np.bincount(inverse) > 1)
        sent = [planes(x) for x in np.split(answers[inverse], np.cumsum(n)[:-1])]
        totals = [0] * len(n), [0] * len(n)
        totals[0][0], totals[1][0] = int(sums.sum()), int((sums > 0).sum())  # a range's totals go with its first row
        return pa.table({"range": table.column("range"), "block": table.column("block"), "sums": pa.array(sent, pa.binary()), "total": pa.array(totals[0], pa.int64()), "distinct": pa.array(totals[1], pa.int64())})

    def store(table: pa.Table) -> pa.Table:
        from pyarrow import fs
        from pyspark import TaskContext

        rows = sorted(table.to_pylist(), key=lambda r: r["range"])
        answers = np.concatenate([unplanes(r["sums"]) for r in rows])
        place, name = fs.FileSystem.from_uri(_answer_file(folder, order, rows[0]["block"]))
        place.create_dir(name.rpartition("/")[0], recursive=True)
        temporary = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with place.open_output_stream(temporary, compression=None) as f:
            f.write(zlib.compress(planes(answers), 1))
        place.move(temporary, name)
        return pa.table({"total": pa.array([sum(r["total"] for r in rows)], pa.int64()), "distinct": pa.array([sum(r["distinct"] for r in rows)], pa.int64())})

    asked = packed.mapInArrow(ask, "range long, block long, keys binary, counts binary").repartition(max(least, 1 + ranges // RANGES_A_TASK), "range")
    answers = asked.groupBy("range").applyInArrow(answer, "range long, block long, sums binary, total long, distinct long")
    stored = answers.repartition(max(least, 1 + n_blocks // BLOCKS_A_TASK), "block").groupBy("block").applyInArrow(store, "total long, distinct long")
    # Written rather than collected: Spark deletes the shuffle files of a write once it is done.
    totals = stored.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    return tuple(written(totals, f"totals-{order}").first())


SCORED = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, learn: Column, priors: Sequence[float] = PRIORS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text, ...).

    ``learn`` says which rows the model learns from; ``priors`` are those of pairs, triples and so on, so their number sets
    the order. base_score adds up the root's arcs alone, score the automaton's; both are log10 probabilities of the text
    and its end. A null text is empty: one token, its end. Rows without doc_id and repeated rows are kept and count each
    time. If nothing is learned from, all words are unknown. An empty table gives an empty result; there are no ties. A text
    is never split, so a very long one is a block of its own. Other columns aren't read.

    Blocks are written once and never move; only counts are shuffled, by hash range and back by block. A word or n-gram
    with any share of all tokens is one count in each block.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    packed = written(blocks(docs, learn, block_tokens), "blocks")
    texts = docs.filter(learn).count()
    size = tuple(packed.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first())
    total, distinct = _count_order(packed, folder, 1, *size)
    for order in range(2, len(priors) + 2):
        _count_order(packed, folder, order, *size)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORED.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                b = _rebuilt(row, folder, len(priors) + 1)
                a = Automaton(b, texts, total, distinct, priors)
                add = lambda x, b=b: pa.array(np.add.reduceat(x, b.starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.doc_ids, mask=b.no_id), pa.array(b.train), pa.array(b.lengths), add((b.orders[0].count > 0)[b.tokens].astype(np.int64)),
                        pa.array(np.full(len(b.lengths), total, np.int64)), add(a.arcs[0][b.tokens]), add(a.traverse(b)),
                    ], names,
                )

    return packed.mapInArrow(rate, SCORED)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    out = score(docs, ~held_out)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
