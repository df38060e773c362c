"""Quality rules (8): rules on a document's own words, then the frequency of its lines across the documents of its host.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACES = r"[\x20\x09-\x0D]+"
SALTS = 32


def _words(text: Column) -> Column:
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, with its white space made single and its digits made one sign."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line, F.lit(SPACE))), SPACES, " "), "[0-9]+", "0")
    return F.xxhash64(clean)


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines (hash and words of each) to docs(text, ...).

    Repeated words are found in the row: windows of three words are hashed; where the hashes aren't all distinct, they are
    sorted with their places, equal neighbours mark places, and the marked places in order give the words they cover.
    That takes n log n steps for a text of n words.
    """
    d = docs.withColumn("_words", _words(F.col("text"))).withColumn("_lines", _lines(F.col("text")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("lines", F.transform("_lines", lambda x: F.struct(line_key(x).alias("h"), F.size(_words(x)).alias("w"))))
    at = F.when(F.size("_words") >= 3, F.sequence(F.lit(1), F.size("_words") - 2)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_at", at).withColumn("_w", F.transform("_at", lambda i: F.xxhash64(F.get("_words", i - 1), F.get("_words", i), F.get("_words", i + 1))))
    d = d.drop("_words", "_lines").withColumn("_again", F.size(F.array_distinct("_w")) < F.size("_w"))
    d = d.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.arrays_zip(F.col("_w").alias("h"), F.col("_at").alias("i")))))
    d = d.drop("_w", "_at", "_again")
    marked = F.filter("_s", lambda x, k: F.coalesce(x["h"] == F.get("_s", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_s", k + 1)["h"], F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(marked, lambda x: x["i"])))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_p")), F.lit(0), lambda n, k: n + F.least(F.lit(3), F.coalesce(F.get("_p", k) - F.get("_p", k - 1), F.lit(3))))
    return d.withColumn("n_repeat_words", F.when(F.size("_p") > 0, covered).otherwise(0).cast("long")).drop("_s", "_p")


def quality(docs: DataFrame, host: str = "source", min_words: int = 50, min_docs: int = 3, share: float = 0.02, keep: float = 0.8) -> DataFrame:
    """doc_id, the base figures, base_failed, removed_words and kept for each row of docs(doc_id, text, source, ...).

    base_failed: fewer than ``min_words`` words, or more than half of them in repeated windows. A line is removed from a
    host's documents if more than ``share`` of the host's distinct documents hold it. That is the same limit for hosts of
    every size; as a share says nothing of a handful of documents, ``min_docs`` of them are never enough. Exact copies are
    one document here, as they are no sign of boilerplate. A document is depleted, and not kept, if fewer than ``keep`` of
    its words remain.

    Lines are counted by distinct (host, line, content), partly before the shuffle; frequent lines are joined back in
    SALTS copies, so that one line with a third of all rows is spread out; what is removed is summed by row. A null host
    is a host of its own; null, empty and wordless texts have no words and fail; null and repeated doc_ids and repeated rows
    keep their rows. Very long texts are judged whole. A line that is held by exactly the limit stays, as does a document
    with exactly ``keep`` of its words. An empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select("doc_id", F.col(host).alias("host"), F.col("text"))
    base = base_rules(rows.withColumn("content", F.unhex(F.md5(F.coalesce("text", F.lit("")))))).drop("text")
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    base = written(base, "quality")

    per_doc = base.select("doc_id", "host", "content", "lines").dropDuplicates(["doc_id", "host", "content"])
    lines = per_doc.select("doc_id", "host", "content", F.explode("lines").alias("l")).select("doc_id", "host", "content", "l.h", "l.w")
    sizes = base.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    seen = lines.select("host", "h", "content").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    common = seen.join(sizes, seen["host"].eqNullSafe(sizes["host"])).filter(F.col("n") > F.col("docs") * share)
    common = common.select(seen["host"].alias("ch"), F.col("h").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("cs"))
    salted = lines.withColumn("s", F.pmod(F.xxhash64("doc_id", "content"), F.lit(SALTS)).cast("int"))
    removed = salted.join(common, salted["host"].eqNullSafe(F.col("ch")) & (F.col("h") == F.col("c")) & (F.col("s") == F.col("cs")))
    removed = removed.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("o"), F.col("content").alias("x")).agg(F.sum("w").alias("removed_words"))
    out = base.join(removed, base["doc_id"].eqNullSafe(F.col("d")) & base["host"].eqNullSafe(F.col("o")) & (base["content"] == F.col("x")), "left")
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * keep)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", gone.alias("removed_words"), kept.alias("kept"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t, md5(coalesce(text, '')) as content,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
p as (
  select rowid, w, unnest(generate_series(1, len(w) - 2)) as i
  from (select row_number() over () as rowid, w from d) where len(w) >= 3),
g as (select rowid, i, count(*) over (partition by rowid, w[i], w[i + 1], w[i + 2]) as c from p),
r as (
  select rowid, count(distinct j) as n
  from (select rowid, unnest([i, i + 1, i + 2]) as j from g where c > 1) group by rowid),
b as (
  select row_number() over () as rowid, * from d),
m as (
  select b.rowid, doc_id, source, content, ls, cast(len(w) as bigint) as n_words,
         cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from b left join r on b.rowid = r.rowid),
l as (
  select rowid, source, content, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
         regexp_replace(regexp_replace(lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') as k
  from (select rowid, source, content, unnest(ls) as x from m)),
z as (select source, count(distinct content) as docs from m group by source),
f as (
  select l.source, l.k from l join z on l.source is not distinct from z.source
  group by l.source, l.k, z.docs having count(distinct content) > 3 and count(distinct content) > z.docs * 0.02),
x as (select l.rowid, sum(l.n) as gone from l join f on l.source is not distinct from f.source and l.k = f.k group by l.rowid),
y as (
  select m.*, cast(coalesce(x.gone, 0) as bigint) as removed_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from m left join x on m.rowid = x.rowid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       not base_failed and n_words - removed_words >= n_words * 0.8 as kept
from y
"""
