import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import token_counts as C

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB = Tokenizer.from_file(BYTES)


def by_hand(rows):
    out = []
    for doc_id, text in rows:
        n = len(LIB.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > 512))
    return sorted(out, key=repr)


def test_odd_rows(odd):
    got = sorted((tuple(r)[:4] for r in C.token_counts(odd, BYTES).collect()), key=repr)
    assert got == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_repeated_rows_are_encoded_once(spark, docs_of, tmp_path):
    rows = [(k, "one text", "en", "s", 0) for k in [None] * 9 + [3] * 9] + [(None, "other", "en", "s", 0)] * 5 + [(4, None, "en", "s", 0), (4, "", "en", "s", 0)]
    got = sorted((tuple(r)[:4] for r in C.token_counts(docs_of(rows), BYTES, f"file://{tmp_path}/c").collect()), key=repr)
    assert got == by_hand([r[:2] for r in rows])
    assert spark.read.parquet(f"file://{tmp_path}/c").count() == 3


def test_hits_are_counted(spark, docs_of, tmp_path):
    cache = f"file://{tmp_path}/c"
    hits = lambda n: [r["was_cached"] for r in C.token_counts(docs_of([(k, f"text {k % n}", "en", "s", 0) for k in range(40)]), BYTES, cache).collect()]
    assert hits(4) == [False] * 40
    assert hits(4) == [True] * 40
    assert sum(hits(8)) == 20  # four texts are known, four are new
    assert spark.read.parquet(cache).count() == 8


def test_empty(empty):
    assert C.token_counts(empty, BYTES).count() == 0


def test_cache(spark, docs_of, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = docs_of([(k, f"text {k % 5}", "en", "s", 0) for k in range(20)])
    assert C.token_counts(first, BYTES, cache).count() == 20
    stored = spark.read.parquet(cache)
    assert stored.count() == 5
    stored.selectExpr("digest", "tokenizer", "n_tokens + 100 as n_tokens").write.parquet(f"file://{tmp_path}/changed")
    more = docs_of([(k, f"text {k}", "en", "s", 0) for k in range(8)])
    got = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(more, BYTES, f"file://{tmp_path}/changed").collect()}
    assert [got[k] > 100 for k in range(8)] == [True] * 5 + [False] * 3  # what is stored isn't encoded again
    assert spark.read.parquet(f"file://{tmp_path}/changed").count() == 8
    # another tokenizer has counts of its own
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {r["doc_id"]: r["n_tokens"] for r in C.token_counts(more, PIECES, f"file://{tmp_path}/changed").collect()}
    assert pieces == {k: len(lib.encode(f"text {k}")) for k in range(8)}
    assert spark.read.parquet(f"file://{tmp_path}/changed").count() == 16


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_digest_tells_tokenizers_apart(name):
    assert (C.tokenizer_digest(public_tokenizers.path(name)) == C.tokenizer_digest(BYTES)) == (name == "byte_bpe_50k.json")


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted((tuple(r)[:4] for r in C.op5_token_counts(spark, sf_dir).collect()), key=repr) == by_hand([(r["doc_id"], r["text"]) for r in docs])
    assert all(r["was_cached"] for r in C.op5_token_counts(spark, sf_dir).collect())
