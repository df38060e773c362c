"""Mixing sources to target weights (2): hash-random order, distributed prefix sums of sizes, an exact cut for each source."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import unused, written

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
RANGES = 1024  # of a source, in a run


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size -> target.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all sizes. A target stops
    at ``cap`` times its source's size, and what is over is shared again by weight until no target is above. That end
    state is min(cap * size, level * weight) for one level: with sources ordered by cap * size / weight, the level is the
    largest of (total - caps so far) / (weights from here on). One row for each source goes through these windows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    own = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    upto = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    own = own.withColumn("most_before", F.sum("most").over(upto) - F.col("most")).withColumn("weight_before", F.sum("weight").over(upto) - F.col("weight"))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("most_before")) / (F.sum("weight").over(every) - F.col("weight_before"))
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return own.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def sized(docs: DataFrame, size: Column, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """docs with each row's size and random key, and the names of these two columns, which docs doesn't have.

    The key hashes doc_id and text, so that rows without doc_id, or with one that is given many times, are spread out too.
    """
    names = unused(docs.columns, "_mix_size", "_mix_key")
    content = F.md5(F.coalesce(F.col("text"), F.lit("")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), content))
    return docs.withColumn(names[0], size.cast("long")).withColumn(names[1], F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("long")), names


def placed(docs: DataFrame, names: Sequence[str], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, rows_per_range: int = 1024) -> tuple[DataFrame, list[str]]:
    """docs of sized() with source_size, target and taken, and the names of these three columns; see mix()."""
    size, key = (F.col(n) for n in names)
    at, upto, s, r, before, source_size, target, taken = unused(docs.columns, "_mix_range", "_mix_upto", "_mix_s", "_mix_r", "_mix_before", "_mix_source_size", "_mix_target", "_mix_taken")
    ranges = max(1, math.ceil(docs.count() / rows_per_range))
    docs = docs.withColumn(at, F.floor(key / F.lit(float(1 << KEY_BITS)) * ranges).cast("long"))
    # Prefix sums in two levels: of the ranges in a run of RANGES, and of the runs of a source. The windows have that many rows.
    sums = docs.groupBy(F.col("source").alias(s), F.col(at).alias(r)).agg(F.sum(size).alias("n")).withColumn("run", F.floor(F.col(r) / RANGES))
    runs = sums.groupBy(F.col(s).alias("rs"), F.col("run").alias("rr")).agg(F.sum("n").alias("rn"))
    running = lambda n, *by: F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    aims = targets(runs.groupBy(F.col("rs").alias("source")).agg(F.sum("rn").alias("source_size")), weights, share, cap)
    runs = runs.withColumn("run_before", running("rn", "rs", "rr"))
    plan = sums.withColumn("range_before", running("n", s, "run", r)).join(runs, F.col(s).eqNullSafe(F.col("rs")) & (F.col("run") == F.col("rr")))
    plan = plan.join(aims, F.col(s).eqNullSafe(F.col("source")))
    plan = plan.select(s, r, (F.col("run_before") + F.col("range_before")).alias(before), F.col("source_size").alias(source_size), F.col("target").alias(target))
    within = Window.partitionBy("source", at).orderBy(key, F.col("doc_id"), size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = docs.withColumn(upto, F.sum(size).over(within)).join(plan, F.col("source").eqNullSafe(F.col(s)) & (F.col(at) == F.col(r)))
    words, whole = F.floor(target).cast("long"), F.col(source_size)
    epochs = F.when(whole > 0, F.floor(words / F.greatest(whole, F.lit(1)))).otherwise(0).cast("long")
    rest = words - epochs * whole - (F.col(before) + F.col(upto) - size)
    out = out.withColumn(taken, (epochs * size + F.greatest(F.lit(0), F.least(size, rest))).cast("long"))
    return out.drop(s, r, before, at, upto), [source_size, target, taken]


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0, rows_per_range: int = 1024) -> DataFrame:
    """Adds size, source_size, target and taken to docs(doc_id, source, text, ...); no row goes, and each row takes 0 to cap times its size.

    Every row gets a key that hashes doc_id and text, and equal ranges of the key cut each source into runs of about
    ``rows_per_range`` rows, so that a source with a third of all rows is spread over as many tasks as its size asks for.
    Sizes are summed by (source, range), the sums are added up along each source in two levels, and a row's place is the sum
    before its range plus the sizes before it within. A source takes its target of words exactly (rounded down): whole epochs
    first, then rows in key order, the last of them in part. Nothing depends on how rows are partitioned, so reruns agree.

    Null sources are a source of their own; ties are ordered by doc_id and size, and rows that are equal in both and in text
    can change places without a change to the result (they share a range, whose sort spills where they are very many). Null,
    empty and wordless texts have no size and take nothing, nor do sources without words. Very long texts are one row each,
    taken in part at most once. An empty table gives an empty result. Columns of docs keep their names and values: where docs
    has a column with the name of an output, the output's name gets an underscore.
    """
    full, names = sized(docs, size, seed)
    full, more = placed(full, names, weights, share, cap, rows_per_range)
    out = unused(docs.columns, "size", "source_size", "target", "taken")
    return full.select(*docs.columns, *[F.col(a).alias(b) for a, b in zip([names[0], *more], out, strict=True)])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row of docs(doc_id, source, text, ...) for each time it is taken, in docs' own columns; a row taken in part keeps the start of its text.

    Rows that take nothing go, as do all without a word. Other columns keep their values, whatever their names; n_chars, if
    docs has it, follows a text that is cut. For nulls, ties, repeated rows and empty tables see mix().
    """
    n, cut_to = unused(docs.columns, "_mix_n", "_mix_part")
    full = mix(docs, word_count(F.col("text")), **how)
    size, taken = (F.col(full.columns[k]) for k in (-4, -1))
    out = full.filter(taken > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.ceil(taken / F.greatest(size, F.lit(1))).cast("int"))))
    out = out.withColumn(cut_to, F.when((part := F.least(size, taken - (F.col(n) - 1) * size)) < size, part.cast("int")))
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.greatest(cut_to, F.lit(1))), "")
    out = out.withColumn("text", F.when(F.col(cut_to).isNull(), F.col("text")).otherwise(start))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut_to).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    own, names = sized(docs, word_count(F.col("text")))
    out, more = placed(written(own.drop("text"), "sizes"), names)  # words are counted once
    return out.select("doc_id", *[F.col(a).alias(b) for a, b in zip([names[0], *more], ("size", "source_size", "target", "taken"), strict=True)])


OP2_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5('0|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))), 1, 15) as bigint) as k
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2.0::double * source_size as most
  from s),
c as (
  select *, sum(most) over o - most as most_before, sum(weight) over o - weight as weight_before
  from w window o as (order by most / weight, source nulls last rows unbounded preceding)),
l as (
  select *, max((all_size * 1.5::double - most_before) / (all_weight - weight_before)) over () as level
  from (select *, cast(sum(source_size) over () as double) as all_size, sum(weight) over () as all_weight from c)),
t as (select source, source_size, least(most, level * weight) as target from l),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows unbounded preceding) - d.size as before,
         case when t.source_size > 0 then cast(floor(floor(t.target) / t.source_size) as bigint) else 0 end as epochs
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(size, cast(floor(target) as bigint) - epochs * source_size - before)) as bigint) as taken
from r
"""
