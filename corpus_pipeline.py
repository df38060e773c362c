"""A training-data pipeline of five operators; every stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.decontam import clean_documents
from linkloom.llm.langid import fit, held_out, identify
from linkloom.llm.mixing import mixed_documents
from linkloom.llm.near_dups import first_of_each
from linkloom.llm.shared import written
from linkloom.llm.token_records import read_records, write_records


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labels know. A text in several known languages stays, whatever the share of each.

    Null, empty and wordless texts and those without a letter go; very long ones are judged whole. Rows without lang or doc_id
    are judged like others, repeated rows each, and further columns keep their values. Without any label every row goes.
    """
    found = identify(docs, fit(docs.filter(~held_out(F.col("doc_id")))))
    return found.filter(F.col(found.columns[len(docs.columns)]) != "und").select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id.

    Of repeated rows one stays; rows without doc_id go if a row with one has the same words, else one of each set stays. Rows
    without a word all stay. Further columns keep their values.
    """
    return first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each row by its own text; null and empty texts stay, and all columns keep their values."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights; a document that is taken twice has two rows.

    Null is a source of its own. Rows without a word take nothing and go. Each repeated row is a row of its own. A text that
    is taken in part keeps its start, and n_chars follows; further columns keep their values.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token records, and returns their index as read back from the files: a row for each row of docs.

    A null text is empty and has its end token only; rows without doc_id come first, repeated rows each have a record; other
    columns aren't read. An empty table gives an empty result, here and in all stages.
    """
    import public_tokenizers

    return read_records(write_records(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dups),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token records", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Language ID, near-dedup on signatures and string tiling aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
