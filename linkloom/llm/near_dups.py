"""MinHash near-dedup (3): one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. Each text gives the set of its five-word shingles, as 64-bit hashes, a digest of the set, and a signature: the hashes
   are dealt to BINS bins by their top bits, a bin's value is its smallest hash, and an empty bin takes the value of the
   first filled bin in a random order of its own (optimal densification). ROWS values in a row hash to a band key.
2. Texts with equal sets are one class, which its smallest doc_id stands for; only that one goes on.
3. Classes with equal band keys share a bucket. A bucket gives star edges only, from its smallest class to the others.
4. Edges are confirmed on full sets, and components are found by alternating large and small stars.
5. Where a bucket is left in several components, STARS more rounds give each such bucket one more star, around a class
   outside the bucket's largest component: again fewer edges than the bucket has classes.
6. What is outside the largest component of its bucket even then is compared with the bucket's others, in blocks, by
   sketches of SKETCH minimal hashes. Only pairs that could be similar leave a block; they are confirmed as the edges
   were. So pairs that share a bucket are in one component, or were compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import MADE, PLACES, WordHashes, discard, lower_words, mixed, ngram_hashes, worker_cache, word_hashes, written

SHINGLE = 5
BINS, ROWS = 128, 4  # 32 bands: a pair at 0.75 shares none with a chance of 5e-6
SIGMAS = 4.5
PER_FILE = 8_000  # documents, whose rows of a thin table share a file
EDGES_PER_FILE = 200_000
SKETCH = 1024  # independent minimal hashes, a byte of each
STARS = 2  # rounds of step 5
BLOCK = 250  # classes of a bucket in a block of step 6


def shingles(text: str | None, cache: WordHashes) -> np.ndarray:
    """Distinct shingle hashes in order; a shorter text is one shingle, none without words."""
    h = word_hashes(lower_words(text), cache)
    return np.unique(ngram_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def probes() -> np.ndarray:
    """For each bin the order in which it asks the others for a value."""
    return np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1)).reshape(BINS, BINS), axis=1)


def signature(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a set (sorted hashes, at least one)."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = np.arange(BINS, dtype=np.uint64)
    value = s[np.minimum(np.searchsorted(s, bins << shift), len(s) - 1)]
    full = value >> shift == bins
    if not full.all():
        value = np.where(full, value, value[order[np.arange(BINS), full[order].argmax(1)]])
    return value


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band, which also tells bands apart."""
    rows = mixed(sig.reshape(-1, ROWS) ^ PLACES[:ROWS]) * PLACES[1 : ROWS + 1]
    return mixed(rows.sum(1, dtype=np.uint64) + np.arange(1, BINS // ROWS + 1, dtype=np.uint64)).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """A byte of the smallest value that each of SKETCH permutations gives to a set's hashes."""
    a = mixed(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 128):
        np.minimum(low, mixed(s[k : k + 128, None] * a).min(0), out=low)
    return (low >> np.uint64(24)).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _cache() -> tuple[WordHashes, np.ndarray]:
    cache = worker_cache("near-dups")
    if "near-dups" not in cache:
        cache["near-dups"] = WordHashes(), probes()
    return cache["near-dups"]


SIGNED = "doc_id long, text_key long, n int, digest binary, keys array<long>, sig binary"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set size n, digest of the set, band keys and the low 16 bits of the signature, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, order = _cache()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n, digests, keys, sigs = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, words)
                    n.append(len(s))
                    if len(s):
                        v = signature(s, order)
                        digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                        keys.append(band_keys(v))
                        sigs.append((v & np.uint64(0xFFFF)).astype("<u2").tobytes())
                    else:
                        digests.append(b""), keys.append(np.empty(0, np.int64)), sigs.append(b"")
                flat = pa.array(np.concatenate(keys))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(sigs, pa.binary())], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Drops pairs (a, b) whose signatures differ by more than SIGMAS standard deviations from those of a similar pair."""
    own = classes.select(F.col("doc_id"), "n", "sig")
    for end in ("b", "a"):
        pairs = pairs.join(own.select(F.col("doc_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sig").alias(f"sig_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("sig_a", "sig_b"))
            n = np.minimum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            filled = BINS * -np.expm1(-n / BINS)
            ok = (x == y).mean(1) >= 0.75 - SIGMAS * np.sqrt(0.75 * 0.25 / filled)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets(doc_id, shingles)."""
    for end in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def split_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """k, m, of, main for the buckets (k, m) that lie in several components: each class's component, and the largest of its bucket."""
    own = buckets.select("k", "m").join(roots.select(F.col("node").alias("m"), F.col("root").alias("of")), "m", "left").select("k", "m", F.coalesce("of", "m").alias("of"))
    sizes = own.groupBy("k", "of").agg(F.count("*").alias("n"))
    main = sizes.groupBy("k").agg(F.max(F.struct("n", "of")).alias("x"), F.count("*").alias("parts")).filter("parts > 1").select("k", F.col("x.of").alias("main"))
    return own.join(main, "k")


def further_stars(split: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): in each bucket of split_buckets one class outside the largest component, another in each round, against those of other components."""
    pick = F.xxhash64("m", F.lit(turn))
    centres = split.filter("of <> main").groupBy("k").agg(F.min(F.struct(pick.alias("h"), "m", "of")).alias("x")).select("k", F.col("x.m").alias("centre"), F.col("x.of").alias("of_centre"))
    return split.join(centres, "k").filter("of <> of_centre").select(F.least("centre", "m").alias("a"), F.greatest("centre", "m").alias("b")).distinct()


def likely_in_blocks(split: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) of a bucket of split_buckets in different components whose sketches are alike.

    Of each pair at least one is outside the bucket's largest component. All of a bucket, and those outside, are dealt to
    blocks of about BLOCK classes, so that it is spread over tasks however large it is, and rows are blocks, not pairs: their
    number is that of the blocks outside times that of all.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(np.frombuffer(x.as_buffer(), "<u8")) for x in part.column(1)], pa.binary())], ["m", "sketch"])

    drawn = sets.join(split.select(F.col("m").alias("doc_id")), "doc_id", "left_semi").mapInArrow(sketches, "m long, sketch binary")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    # Few buckets fill more than a block. Written, that table shows its size, so members move for this join only if it is large.
    large = written(split.groupBy("k").agg(blocks(F.count("*")).alias("blocks"), blocks(F.count_if(F.col("of") != F.col("main"))).alias("blocks_outside")).filter("blocks > 1"), "large", parts=parts)
    block = lambda n: F.pmod(F.xxhash64("m"), F.coalesce(n, F.lit(1))).cast("int")
    shared = split.groupBy("m").agg(F.collect_set("k").alias("ks"))
    own = split.join(large, "k", "left").withColumn("block", block("blocks")).withColumn("outside", F.when(F.col("of") != F.col("main"), block("blocks_outside")))
    own = own.join(drawn, "m").join(shared, "m")
    cells = written(own.groupBy("k", "block").agg(F.collect_list(F.struct("m", "of", "outside", "sketch", "ks")).alias("y")), "blocks", parts=parts)
    outside = cells.select("k", F.explode(F.filter("y", lambda c: c["outside"].isNotNull())).alias("x")).groupBy("k", "x.outside").agg(F.collect_list("x").alias("x"))
    pairs = written(outside.select("k", "x"), "outside", parts=parts).join(cells.select("k", "y"), "k").select("k", "x", "y")
    enough = 0.75 + 0.25 / 256 - SIGMAS * np.sqrt(0.75 * 0.25 / SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y in zip(batch.column("k").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                (m, of, s, ks), (n, by, t, kt) = (
                    (c.values.field("m").to_numpy(), c.values.field("of").to_numpy(), np.frombuffer(b"".join(c.values.field("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH), [set(z) for z in c.values.field("ks").to_pylist()])
                    for c in (x, y)
                )
                a, b = [], []
                for i in range(len(m)):
                    other = np.flatnonzero(by != of[i])
                    for j in other[(t[other] == s[i]).mean(1) >= enough]:
                        if min(ks[i] & kt[j]) == key:  # of the buckets that both are in, one names the pair
                            a.append(min(m[i], n[j]))
                            b.append(max(m[i], n[j]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for all ends of edges(a, b) but the roots: the smallest end that each can be reached from.

    Large stars hang a node's larger neighbours on its smallest one, small stars the others; in turn they end in a star
    for each component, after a number of rounds that grows with the logarithm of its size. Every step is written, and
    joins take plain tables, so that adaptive execution can split the edges of a hub.
    """

    def star(e: DataFrame, large: bool, parts: int) -> DataFrame:
        big, small = F.greatest("a", "b"), F.least("a", "b")
        one = e.select(big.alias("u"), small.alias("v"))
        s = one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else one
        low = written(s.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "low", parts=parts)
        if large:
            out = s.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = s.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return written(out.distinct(), "star", parts=parts)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")), F.lit(1 << 40))), F.lit(0))).first())

    before = None
    while True:
        now = state(edges)
        if now == before or now[0] == 0:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = now
        parents = edges.agg(F.count("*"), F.countDistinct(F.greatest("a", "b"))).first()
        if parents[0] == parents[1] and not edges.select(F.greatest("a", "b").alias("x")).join(edges.select(F.least("a", "b").alias("x")), "x", "left_semi").limit(1).count():
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))  # stars already
        parts = 1 + now[0] // EDGES_PER_FILE
        edges = star(star(edges, True, parts), False, parts)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text, ...).

    Two rows are linked if their sets have a similarity of 75 % or more; component_id is the smallest doc_id that can be
    reached. Null, empty and wordless texts have no shingle, no link and are kept. Rows that share a doc_id are one
    document, whose rows count by their own texts. Rows without doc_id are linked with nothing: component_id is null and
    they are kept. Repeated rows (doc_id and text) all have a row in the result, and count once in all steps. Of equal sets
    the smallest doc_id stands for all. Texts are read whole. An empty table gives an empty result. Other columns aren't read.

    Recall: a similar pair shares no bucket with a chance of 5e-6, and no pair is left out for the size of its bucket.
    Of pairs that share one, signatures and sketches wrongly drop one in some hundred thousand at 75 %, next to none above 80 % (SIGMAS standard deviations).
    Copies cost one row each, near copies one edge for each bucket, of 32, and for each round of step 5, and what step 6 finds outside the stars.
    """
    return verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """near_duplicates with the text_key of each row, and first: whether it is one of those that stand for their class and the class for its component."""
    since = len(MADE)
    base = written(signed(docs), "signed")
    parts = 1 + base.count() // PER_FILE
    thin = lambda df, name: written(df, name, parts=parts)
    # Repeated rows meet partly before the shuffle, and are one row from here on.
    named = base.filter("n > 0 and doc_id is not null")
    repeated = bool(named.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count())
    named = named.dropDuplicates(["digest", "doc_id", "text_key"]) if repeated else named
    # The smallest doc_id of a class, if any row has one, and with it the smallest text_key.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("x")
    classes = thin(base.filter("n > 0").groupBy("digest").agg(smallest).select("digest", "x.doc_id", F.col("x.text_key").alias("first_key")), "classes")
    first_rows = classes.select("digest", "doc_id", F.col("first_key").alias("text_key"))
    reps = thin(named.join(first_rows, ["digest", "doc_id", "text_key"], "left_semi").select("doc_id", "text_key", "n", "sig", "keys"), "reps")

    member = reps.select(F.explode("keys").alias("k"), F.col("doc_id").alias("m"))
    stars = thin(member.groupBy("k").agg(F.min("m").alias("centre"), F.max("m").alias("last")).filter("last > centre").select("k", "centre"), "centres")
    buckets = thin(member.join(stars, "k").select("k", "centre", "m"), "buckets")

    wanted = buckets.select(F.col("m").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    texts = texts.dropDuplicates(["doc_id", "text_key"]) if repeated else texts
    texts = texts.join(reps.select("doc_id", "text_key").join(wanted, "doc_id", "left_semi"), ["doc_id", "text_key"], "left_semi").select("doc_id", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = _cache()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words).astype("<u8").tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "shingles"])

    sets = thin(texts.mapInArrow(sets_of, "doc_id long, shingles binary"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        return thin(confirmed(thin(pairs, "likely"), sets).distinct(), "edges")

    edges = confirm(likely(buckets.filter("m <> centre").select(F.col("centre").alias("a"), F.col("m").alias("b")).distinct(), reps))
    roots = components(edges)

    def with_more(found: DataFrame) -> DataFrame:
        """The stars found so far stand for their edges."""
        return components(thin(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(found), "edges"))

    for turn in range(STARS + 1):
        split = thin(split_buckets(buckets, roots), "split")
        if not split.limit(1).count():
            break
        more = confirm(likely(further_stars(split, turn), reps) if turn < STARS else likely_in_blocks(split, sets, parts))
        if more.limit(1).count():
            roots = with_more(more)

    named_roots = roots.select(F.col("node").alias("doc_id"), F.col("root"))
    found = thin(classes.join(named_roots, "doc_id", "left").select("digest", F.col("doc_id").alias("first_id"), "first_key", F.coalesce("root", "doc_id").alias("root")), "roots")
    discard(docs.sparkSession, since, "signed", "roots")  # the result reads these alone
    out = base.select("doc_id", "text_key", "n", "digest").join(found, "digest", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "doc_id"))
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")) & F.col("first_id").eqNullSafe(F.col("root"))
    return out.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), ((F.col("n") == 0) | first).alias("first"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one document of each group of near copies, the one with the smallest doc_id.

    Rows are judged by doc_id and text, and one row of each class of equal shingle sets stays at most. So of rows that
    share a doc_id each stays or goes by its own text, and of repeated rows (same doc_id and text) one stays. Rows without
    doc_id go if a row with one has the same set; else one of the class stays. Near copies that aren't of one class stay if
    they have the same doc_id, as one document, or no doc_id, as those are linked with nothing. Rows without a word all stay.
    """
    since = len(MADE)
    found = written(verdicts(docs).filter("n_shingles > 0").groupBy("doc_id", "text_key", "first").agg(F.count("*").alias("rows")), "verdicts")
    discard(docs.sparkSession, since, "verdicts")
    ids, key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"])

    def of(rows: DataFrame, verdict: DataFrame, how: str) -> DataFrame:
        own = verdict.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        return rows.join(own, ids.eqNullSafe(F.col("_id")) & (key == F.col("_key")), how)

    again = found.filter("first and rows > 1")
    if not again.limit(1).count():
        return of(docs, found.filter("not first"), "left_anti")
    once = of(docs, found.filter("not first or rows > 1"), "left_anti")
    return once.unionByName(of(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
