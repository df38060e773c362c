"""Language ID (4): script ranges narrow a word's candidates, n-gram scores rate them, Viterbi labels spans of the text."""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_size, unused, worker_cache

WORD = re.compile(r"[^\W\d_]+")
# First code points of ranges, and their scripts.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"),
    (0x0780, "Thaana"), (0x07C0, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3005, "Han"), (0x3041, "Kana"), (0x3105, "Other"), (0x3131, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7FF, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
)
STARTS, NAMES = [x[0] for x in SCRIPTS], sorted({x[1] for x in SCRIPTS})
SCRIPT_IDS = [NAMES.index(x[1]) for x in SCRIPTS]

BUCKETS = 1 << 16
LONGEST = 4  # bytes in an n-gram
SMOOTHING = 0.5
TEMPERATURE = 3.0  # n-grams of a word overlap, so their sum says too much
FLOOR = -8.0
PENALTY = 6.0  # of a switch, in the units of a word's log-probability
LEAST_SHARE = 0.01  # of a language's words in a script, for it to be a candidate there
MOST_WORDS = 200_000  # remembered by a worker
MOST_LANGUAGES = 512  # a bound of the model's size: 128 MB


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case, with signs like raised digits only beside a letter; null: none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def script_of(word: str) -> int:
    return SCRIPT_IDS[bisect.bisect_right(STARTS, ord(word[0])) - 1]


def ngrams(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words, ends included, and the word that each belongs to."""
    data = np.frombuffer(("\n" + "\n".join(new) + "\n").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    sep = data == 10
    owner = np.cumsum(sep) - 1  # of the word that begins after the last separator
    buckets, owners = [], []
    h = np.zeros(len(data), np.uint64)
    inner = np.zeros(len(data), bool)  # a separator at a place other than the ends
    for n in range(1, LONGEST + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        h = (h[:size] + data[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if n > 2:
            inner = inner[:size] | sep[n - 2 : n - 2 + size]
        else:
            inner = inner[:size]
        ok = ~inner & ~(sep[:size] & sep[n - 1 :]) if n > 1 else ~sep
        at = np.flatnonzero(ok)
        buckets.append((h[at] >> np.uint64(7)) % np.uint64(BUCKETS))
        owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Numbered(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        i = self[key] = len(self)
        return i


def fit(labelled: DataFrame, rows_per_language: int = 5000) -> dict:
    """A model from labelled(doc_id, text, lang): for each language, how often its words hold each of BUCKETS n-grams.

    About ``rows_per_language`` distinct texts of each language are learned from, all if it has fewer: those whose hash falls
    below a share. Copies of a text count once, so that bound holds whatever the table's size and however often a text is
    copied, each task reads few texts and the driver gets BUCKETS sums a language. Rows without text or lang are left out.
    """
    own = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("text").alias("key"))
    counts = {r["lang"]: r["count"] for r in own.select("lang", "key").distinct().groupBy("lang").count().collect()}
    langs = sorted(counts)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; a model holds {MOST_LANGUAGES}")
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "scripts": np.zeros((len(NAMES), 0), bool)}
    shares = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_language / counts[k])))])
    picked = own.filter(F.pmod("key", F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20)).dropDuplicates(["lang", "key"]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {k: np.zeros(BUCKETS + len(NAMES), np.int64) for k in langs}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w := words(text):
                    table[lang][:BUCKETS] += np.bincount(ngrams(w)[0], minlength=BUCKETS)
                    table[lang][BUCKETS:] += np.bincount([script_of(x) for x in w], minlength=len(NAMES))
        for k, v in table.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])

    sums = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    n = np.zeros((BUCKETS + len(NAMES), len(langs)))
    place = {k: i for i, k in enumerate(langs)}
    for r in sums.toLocalIterator():
        n[r["bucket"], place[r["lang"]]] = r["n"]
    grams, scripts = n[:BUCKETS] + SMOOTHING, n[BUCKETS:]
    return {"langs": langs, "table": np.log(grams / grams.sum(0)).astype(np.float32), "scripts": scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1)}


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of several sequences laid end to end: scores (n, k), a penalty for each change of label.

    Step t treats the t-th items of all sequences that are so long, so the work is that of the items.
    """
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    begin, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order) or k < 2:
        return out
    first, size = begin[order], lengths[order]
    alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # sequences with a t-th item
    stay, best, rows = np.zeros((n, k), bool), np.zeros(n, np.int8 if k < 128 else np.int16), np.arange(len(order))
    v = scores[first].copy()
    for t in range(1, len(alive)):
        m, at = alive[t], first[: alive[t]] + t
        now = v[:m]
        top = now.argmax(1)
        jump = (now[rows[:m], top] - penalty)[:, None]
        stay[at], best[at] = now >= jump, top
        v[:m] = np.maximum(now, jump) + scores[at]
    label = v.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        m, at = alive[t], first[: alive[t]] + t
        now = label[:m]
        out[at] = now
        label[:m] = np.where(stay[at, now], now, best[at])
    return out


class Labeller:
    """Rates words by a model and labels texts; a worker keeps the ratings of words that it has met."""

    def __init__(self, model: dict, penalty: float):
        self.model, self.penalty, self.k = model, penalty, len(model["langs"])
        self.clear()

    def clear(self) -> None:
        self.place, self.scores, self.letters = Numbered(), np.zeros((0, self.k), np.float32), np.zeros(0, np.int64)

    def rate(self, new: list[str]) -> np.ndarray:
        """Log-probability of each language for each word; a language that isn't written in the word's script has FLOOR."""
        out = np.empty((len(new), self.k), np.float32)
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            bucket, owner = ngrams(part)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(part)))
            s = np.add.reduceat(self.model["table"][bucket[order]], cuts, axis=0) / TEMPERATURE
            fits = self.model["scripts"][[script_of(w) for w in part]]
            s = np.where(fits, s, -np.inf)
            s[~fits.any(1)] = 0.0  # a script that no language has tells nothing
            s -= s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            out[a : a + len(part)] = np.maximum(s, FLOOR)
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """For each text its language, the share of its letters in spans of that language, and the spans (first word, end, language)."""
        if len(self.place) > MOST_WORDS:
            self.clear()
        known, docs = len(self.place), [words(t) for t in texts]
        index = [np.fromiter(map(self.place.__getitem__, w), np.int64, len(w)) for w in docs]
        if not self.k:
            return [("und", 0.0, [])] * len(texts)
        if len(self.place) > known:
            new = list(islice(self.place, known, None))
            self.scores = np.concatenate([self.scores, self.rate(new)])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int64, len(new))])
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.concatenate(index) if len(docs) else np.zeros(0, np.int64)
        labels = viterbi(self.scores[flat], lengths, self.penalty)
        letters, out, at, langs = self.letters[flat], [], 0, self.model["langs"]
        for n in lengths.tolist():
            if not n:
                out.append(("und", 0.0, []))
                continue
            own = labels[at : at + n]
            share = np.bincount(own, letters[at : at + n], self.k)
            best = int(share.argmax())
            cuts = np.flatnonzero(np.diff(own)) + 1
            spans = [(int(a), int(b), langs[own[a]]) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
            out.append((langs[best], float(share[best] / share.sum()), spans))
            at += n
        return out


def _labeller(broadcast: Broadcast, uid: str, penalty: float) -> Labeller:
    cache = worker_cache("langid")
    if cache.get("langid-uid") != uid:
        cache["langid"], cache["langid-uid"] = Labeller(broadcast.value, penalty), uid
    return cache["langid"]


SPANS = "array<struct<first_word: int, end_word: int, lang: string>>"


def identify(docs: DataFrame, model: dict, penalty: float = PENALTY) -> DataFrame:
    """docs(text, ...) with lang_pred, score and spans as the last three columns, in one pass without a shuffle.

    Nothing but the text is looked at. lang_pred is a language of the model, or und (score 0, no spans) for texts that
    are null or have no letter; of languages with equal shares the first by name. The model has BUCKETS figures a
    language, of MOST_LANGUAGES at most, and is broadcast. A very long text is labelled whole, as a batch of its own. Repeated
    rows and nulls in other columns stay, and so do the values of all columns of docs: where docs has a column with the name
    of an output, the output's name gets an underscore. Without any labelled row every text is und. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    sent, uid, at = spark.sparkContext.broadcast(model), uuid.uuid4().hex, docs.columns.index("text")
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
    own = unused(docs.columns, "lang_pred", "score", "spans")
    names = [*docs.columns, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(sent, uid, penalty)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in by_size(texts, 2 << 20):
                got = labeller.label(texts[a:b])
                spans = pa.array([[{"first_word": x, "end_word": y, "lang": z} for x, y, z in g[2]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, ", ".join([*([fields] if fields else []), f"`{own[0]}` string", f"`{own[1]}` double", f"`{own[2]}` {SPANS}"]))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
