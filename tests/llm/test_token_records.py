import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import token_records as T

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
HARD = ["It's, 'tis a'.,b abc'. x.y, 3.5, É, Été Å á. áb, \x1ca \x85b c\xa0d, İ <|endoftext|>x", "<|ENDOFTEXT|> a", "", " \n", "ß ÿ ŒUVRE œuvre, naïve. Ǆ ﬁ ³ ½ ᾳ Σας, ΣΑΣ. ", "don't. I'd, we'll. they've, x's.", "a...b ... a., b,. c., a### a.%%% é&&& !!a a!! ÷. x÷.", "́a á. é́, ́.", "漢字 かな 한국 \U0001f600. \U0001f600,", "a\x00b \x00."]


def library(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_librarys_ids():
    rng = random.Random(2)
    alphabet = "abcdeé'.,!#$ \n\x0b0ßÉ÷-<|>漢́\xa0"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for most in (10, 400_000):  # with a memory that is emptied again and again too
        enc = T.WordEncoder(PATH, most)
        for a in range(0, len(texts), 97):
            for text, got in zip(texts[a : a + 97], enc.encode(texts[a : a + 97]), strict=True):
                assert list(got) == library(text), text
    assert [list(x) for x in T.WordEncoder(PATH).encode([None])] == [[]]


def check(got, rows):
    """got (doc_id, start, n_tokens, ids_crc32, ...) holds a record for each row (doc_id, text), in ascending order of doc_id, nulls first."""
    got, at = sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]), 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = []
    for doc_id, text in rows:
        x = np.array([*library(text), 1], "<u4")
        want.append((doc_id, len(x), zlib.crc32(x.tobytes())))
    assert sorted(((r[0], *r[2:]) for r in got), key=repr) == sorted(want, key=repr)


COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("shard_bytes", [T.SHARD_BYTES, 200])
def test_round_trip(spark, odd, shard_bytes):
    manifest = T.write_records(odd, PATH, shard_bytes=shard_bytes)
    got = T.read_records(manifest).select(COLUMNS).collect()
    check(got, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sum(r["n_tokens"] for r in manifest.collect()) == sum(r["n_tokens"] for r in got)
    assert (manifest.count() > 8) == (shard_bytes < T.SHARD_BYTES)  # more shards than tasks


def test_a_doc_id_of_many_rows_is_split(docs_of):
    rows = [(7 if k % 3 else k, f"text {k}", "en", "s", 0) for k in range(600)]
    manifest = T.write_records(docs_of(rows), PATH)
    assert max(r["n_records"] for r in manifest.collect()) < 200
    check(T.read_records(manifest).select(COLUMNS).collect(), [r[:2] for r in rows])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_of_the_library(name):
    enc, lib = T.WordEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert enc.wordwise == (name == "word_bpe_49k.json")
    assert [list(x) for x in enc.encode([*HARD, None])] == [lib.encode(t, add_special_tokens=False).ids for t in [*HARD, ""]]


def test_shuffled_read(spark, odd):
    for row in T.write_records(odd, PATH).collect():
        a, b = ([(d, i.tolist()) for d, i in T.read_shuffled(row["file"], 3)] for _ in range(2))
        assert a == b and len(a) == row["n_records"]


def test_empty(empty):
    assert T.read_records(T.write_records(empty, PATH)).count() == 0


def test_damage_is_found():
    good = T.frame(7, np.array([1, 2, 3], np.uint32), 2)
    assert T.unframe(good)[0] == 7 and T.unframe(good)[1].tolist() == [1, 2, 3]
    assert T.unframe(T.frame(None, np.array([70000], np.uint32), 4))[0] is None
    for k in range(len(good)):
        with pytest.raises(T.DamagedRecord):
            T.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
        with pytest.raises(T.DamagedRecord):
            T.unframe(good[:k])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(T.op1_token_records(spark, sf_dir).select(COLUMNS).collect(), [(r["doc_id"], r["text"]) for r in docs])
