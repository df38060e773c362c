"""What the operators share: the shared folder, written stages, words, hashes, a per-worker cache."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

from linkloom.sources.scratch import MADE, clean, discard, new_folder, shared_dir, written

__all__ = ["MADE", "clean", "discard", "new_folder", "shared_dir", "written"]

#: Odd multipliers that give each place of an n-gram its own weight.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores added as it takes to be none of the columns (as Spark compares them)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """The number of partitions that the session deals shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker runs tasks of one operator; the next operator's replaces it, and the memory goes back."""
    own = sys.modules.setdefault("_linkloom_worker_cache", types.ModuleType("_linkloom_worker_cache")).__dict__
    if own.get("owner") != owner:
        own["owner"], own["held"] = owner, {}
        give_back()
    return own["held"]


def give_back() -> None:
    """Returns freed memory to the system, which the C library would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_size(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts, as (begin, end), of about so many characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash. Emptied now and then, so that it stays small; the values don't depend on that."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a sequence of word hashes; empty if it is shorter."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += mixed(h[k : len(h) - n + 1 + k] ^ PLACES[k % 5]) * PLACES[(k + 1) % 5] * np.uint64(2 * k + 1)
    return mixed(out)


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; null: none. bytes.split and bytes.lower know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
