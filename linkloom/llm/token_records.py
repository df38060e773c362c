"""Token-ID / binary output (1): length-delimited records of token ids, with masked checksums and a separate offset index.

A shard is a file of records, in ascending doc_id order, of about SHARD_BYTES at most; shards follow each other in that order
too. A record is

    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

and a payload is ``i64 doc_id | u32 number of ids | u8 bytes per id (2 or 4) | ids``, all little-endian. Beside each shard
lies an index, ``u64 offset | u64 length of the record`` for each record, through which records can be read in any order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_size, new_folder, width, worker_cache, written

HEAD, BODY, CRC = "<QI", "<qIB", "<I"
HEAD_SIZE, BODY_SIZE, CRC_SIZE = map(struct.calcsize, (HEAD, BODY, CRC))
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
NO_ID = -(1 << 63)  # stands for a null doc_id
SHARD_BYTES = 256 << 20
# How a tokenizer's file says that it treats words one by one, as WordEncoder does.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


class DamagedRecord(ValueError):
    """A checksum or a length doesn't fit."""


def masked_crc(data: bytes) -> int:
    """crc32, rotated and shifted by a constant, so that checksums of data that hold checksums stay sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, id_bytes: int) -> bytes:
    payload = struct.pack(BODY, NO_ID if doc_id is None else doc_id, len(ids), id_bytes) + ids.astype("<u2" if id_bytes == 2 else "<u4").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(CRC, masked_crc(size)) + payload + struct.pack(CRC, masked_crc(payload))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record; raises DamagedRecord."""
    if len(record) < HEAD_SIZE + CRC_SIZE:
        raise DamagedRecord("a record is cut off")
    size, crc = struct.unpack_from(HEAD, record)
    if masked_crc(record[:8]) != crc or len(record) != HEAD_SIZE + size + CRC_SIZE:
        raise DamagedRecord("the length doesn't fit")
    payload = record[HEAD_SIZE : HEAD_SIZE + size]
    if masked_crc(payload) != struct.unpack_from(CRC, record, HEAD_SIZE + size)[0]:
        raise DamagedRecord("the checksum doesn't fit")
    doc_id, n, id_bytes = struct.unpack_from(BODY, payload)
    ids = np.frombuffer(payload, "<u2" if id_bytes == 2 else "<u4", n, BODY_SIZE)
    return None if doc_id == NO_ID else doc_id, ids


def records(f, index: np.ndarray, chunk: int = 8 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of an open shard in file order, read in chunks."""
    k = 0
    while k < len(index):
        begin, end = int(index["offset"][k]), k
        while end < len(index) and (end == k or int(index["offset"][end] + index["length"][end]) - begin <= chunk):
            end += 1
        f.seek(begin)
        data = f.read(int(index["offset"][end - 1] + index["length"][end - 1]) - begin)
        for i in range(k, end):
            at = int(index["offset"][i]) - begin
            yield unframe(data[at : at + int(index["length"][i])])
        k = end


class Places(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: bytes) -> int:
        i = self[key] = len(self)
        return i


class WordEncoder:
    """Token ids of whole texts as the library gives them.

    A tokenizer that drops white space and never joins across it gives a text the ids of its words in turn, so each
    distinct word is encoded once. A run of stops and signs after a Latin-1 small letter or a digit and before white space
    is a piece of its own, and is split off first. Texts with strings of special tokens are encoded in one piece, and all
    texts are if the tokenizer's file doesn't have the normaliser and the splitter for which that holds (WORDWISE).
    """

    #: Letters that lower-casing and NFC keep, and that \\p{L} holds in every version of Unicode.
    LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    STOP = re.compile(rb"([.,!?;:#$%&*](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[.,!?;:#$%&*]*+)(?=[\x20\x09-\x0D]|\Z)")

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            how = json.load(f)
        self.wordwise = all(how.get(k) == v for k, v in WORDWISE.items()) and how["model"]["type"] == "BPE"
        self.tok, self.most = Tokenizer.from_file(path), most
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        #: The byte-level alphabet: a byte that prints stands for itself, the others for characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.table = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.id_bytes = 2 if self.tok.get_vocab_size() <= 0x10000 else 4
        self.clear()

    def clear(self) -> None:
        self.seen = Places()
        self.begin, self.count, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def learn(self, new: list[bytes]) -> None:
        """Appends the ids of new words. What the library's normaliser and splitter leave alone, a word of Latin-1 small
        letters, goes straight to its BPE model, other words through the whole library."""
        model, letters, table = self.tok.model, self.LETTERS.fullmatch, self.table
        words = [w.decode("utf-8", "replace") for w in new]
        got: list = [model.tokenize(w) if x.isalpha() else model.tokenize(x.decode("latin-1").translate(table)) if letters(w) else None for w, x in zip(words, new, strict=True)]
        got = [None if x is None else [t.id for t in x] for x in got]
        rest = [i for i, x in enumerate(got) if x is None]
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                got[i] = e.ids
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(len(flat) + len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin, self.count = np.append(self.begin, self.used + np.cumsum(n) - n), np.append(self.count, n)
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.wordwise:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.seen) > self.most:
            self.clear()
        known, docs = len(self.seen), []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            if any(s in data for s in self.special):
                docs.append(None)
            else:
                words = self.STOP.sub(rb" \1", data).split()
                docs.append(np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)))
        if len(self.seen) > known:
            self.learn(list(islice(self.seen, known, None)))
        flat = np.concatenate([x for x in docs if x is not None] or [np.zeros(0, np.int64)])
        n = self.count[flat] if len(flat) else flat
        ends = np.cumsum(n)
        out = self.ids[np.arange(int(n.sum())) + np.repeat(self.begin[flat] - (ends - n), n)] if len(flat) else np.zeros(0, np.uint32)
        result, word, at = [], 0, 0
        for text, x in zip(texts, docs, strict=True):
            if x is None:
                result.append(np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            word += len(x)
            end = int(ends[word - 1]) if word else 0
            result.append(out[at:end])
            at = end
        return result


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("token-records")
    if ("word-encoder", path) not in cache:
        cache["word-encoder", path] = WordEncoder(path)
    return cache["word-encoder", path]


MANIFEST = "task int, shard int, file string, n_records long, n_tokens long, n_bytes long"


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs(doc_id, text, ...) and writes the shards. Returns their manifest, which is written beside them.

    One shuffle: rows are range-partitioned by doc_id (and by a hash of the text, so that a doc_id of very many rows is split
    too) and sorted within, so that task k holds no larger ids than task k+1. A task begins another shard when one has
    ``shard_bytes``, so what it holds doesn't grow with the corpus. It writes under a name of its own and then renames; as the
    rows of a task and their order are fixed, a repeated task leaves the same shards. A null text is empty, a null doc_id
    comes first; repeated rows and those that share a doc_id all stay; a very long text is one record; further columns are
    not read. An empty table gives no shard. Any tokenizer of the library will do.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, task, attempt = encoder(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(f"{folder}/records")
        shard, f, index, at, tokens, tail = 0, None, array("Q"), 0, 0, np.array([end_id], np.uint32)

        def name() -> str:
            return f"part-{task:06d}-{shard:06d}"

        def done() -> pa.RecordBatch:
            f.close()
            with store.open_output_stream(f"{root}/{name()}.{attempt}.idx.tmp") as g:
                g.write(np.array(index, "<u8").tobytes())
            for kind, end in ((".tmp", ".rec"), (".idx.tmp", ".idx")):
                store.move(f"{root}/{name()}.{attempt}{kind}", f"{root}/{name()}{end}")
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [f"{folder}/records/{name()}"], "n_records": [len(index) // 2], "n_tokens": [tokens], "n_bytes": [at]})

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_size(texts):
                for doc_id, got in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    if f is None:
                        store.create_dir(root, recursive=True)
                        f = store.open_output_stream(f"{root}/{name()}.{attempt}.tmp")
                    data = frame(doc_id, np.concatenate([got, tail]), enc.id_bytes)
                    f.write(data)
                    index.extend((at, len(data)))
                    at, tokens = at + len(data), tokens + len(got) + 1
                    if at >= shard_bytes:
                        yield done()
                        shard, f, index, at, tokens = shard + 1, None, array("Q"), 0, 0
        if f is not None:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    dealt = rows.repartitionByRange(width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shards = dealt.mapInArrow(write, MANIFEST).collect()  # a row for each shard
    return written(spark.createDataFrame(shards, MANIFEST), "manifest", f"{folder}/manifest", parts=1)


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start (ids before the document), n_tokens, ids_crc32, file, file offset.

    The start of a shard is a prefix sum over the manifest, which has a row for each shard; within a shard ids are
    counted as they are read. Every length and checksum is tested.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["file"])
                with store.open_input_stream(f"{name}.idx") as g:
                    index = np.frombuffer(g.read(), INDEX)
                out, start = [], row["start"]
                with store.open_input_file(f"{name}.rec") as f:
                    for k, (doc_id, ids) in enumerate(records(f, index)):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["name"], int(index["offset"][k])))
                        start += len(ids)
                        if len(out) == 10_000 or k == len(index) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])
                            out = []

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.select("file", F.element_at(F.split("file", "/"), -1).alias("name"), before.cast("long").alias("start"))
    return rows.repartitionByRange(width(manifest.sparkSession), "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, offset long")


def read_shuffled(file: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one shard in a random order that the seed fixes, through the offset index."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(file)
    with store.open_input_stream(f"{name}.idx") as g:
        index = np.frombuffer(g.read(), INDEX)
    with store.open_input_file(f"{name}.rec") as f:
        for k in np.random.default_rng(seed).permutation(len(index)):
            f.seek(int(index["offset"][k]))
            yield unframe(f.read(int(index["length"][k])))


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_records(write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
