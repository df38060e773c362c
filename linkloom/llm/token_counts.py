"""Token counts (5): a cache of counts by digest of content and of tokenizer; only distinct contents that it lacks are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_size, new_folder, worker_cache, written

PER_FILE = 20_000  # documents, whose counts share a file
CACHE = "digest binary, tokenizer string, n_tokens long, run string"


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's file, its library's version and how it is called: a change to any makes old counts void."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib}|no added tokens".encode()).hexdigest()


def counter(path: str):
    """Texts to numbers of tokens."""
    cache = worker_cache("token-counts")
    if ("token-counter", path) in cache:
        return cache["token-counter", path]
    if path.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
    else:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        count = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
    cache["token-counter", path] = count
    return count


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, was_cached for each row of docs(doc_id, text, ...); a null text is empty.

    Content is normalised only in that null becomes empty, as anything further would change counts. Its SHA-256 is joined
    with the cache's rows for this tokenizer; of the digests that are missing, one row each is encoded and appended to the
    cache, a folder of Parquet that later calls can pass again (without one, the call has a new cache of its own). was_cached
    says that the count was there before the call. Texts go through one shuffle, by digest and doc_id, so that a text with any
    number of copies moves as its single rows and only its chosen row meets the encoder; where nothing is missing, no text
    moves. Of copies the smallest doc_id is chosen. Null and repeated doc_ids and repeated rows are kept, and very long texts
    are encoded whole. An empty table gives an empty result. Other columns aren't read.
    """
    spark, version, run = docs.sparkSession, tokenizer_digest(tokenizer), uuid.uuid4().hex
    cache = cache or new_folder(spark, "token-cache")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    keyed = written(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    parts = 1 + keyed.count() // PER_FILE

    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        spark.createDataFrame([], CACHE).write.parquet(cache)
    known = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    ids = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    firsts = ids.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rows")).alias("first"))
    misses = written(firsts.join(known(), "digest", "left_anti").select("digest", "first.doc_id", "first.rows"), "misses", parts=parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            digests, rows = batch.column(0), batch.column(1).to_pylist()
            n = [x for a, b in by_size(rows, 1 << 20) for x in count(rows[a:b])]
            yield pa.RecordBatch.from_arrays([digests, pa.array(n, pa.int64())], ["digest", "n_tokens"])

    if misses.limit(1).count():
        own = misses.select(F.col("digest").alias("d"), F.col("doc_id").alias("first"))
        chosen = texts.join(own, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("digest", "text")
        if misses.filter("rows > 1").limit(1).count():  # repeated rows: the same text under the same id, or without one
            chosen = chosen.dropDuplicates(["digest"])
        found = chosen.mapInArrow(encode, "digest binary, n_tokens long")
        # A thin shuffle of its own, so that fewer files don't mean fewer tasks that encode.
        found = found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        found.select("digest", F.lit(version).alias("tokenizer"), "n_tokens", F.lit(run).alias("run")).coalesce(parts).write.mode("append").parquet(cache)
    # Calls at the same time can both append a digest. Written out, its one row is a plain side of the join, so that
    # adaptive execution can split a digest with very many copies on the other side.
    before = F.coalesce(F.col("run") != run, F.lit(True))
    counts = written(known().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.max(before).alias("was_cached")), "counts", parts=parts)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "was_cached")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, tokenizer, cache = spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-cache")
    token_counts(docs, tokenizer, cache)  # fills the cache
    return token_counts(docs, tokenizer, cache)  # finds every digest there, and encodes nothing
