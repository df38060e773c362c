import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and wordless and very long texts, ties, repeated rows."""
    rng = random.Random(1)
    long = words(rng, 30_000, 5000)
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b\f\r ", "en", "b", 7), (4, "one two", "en", None, 7), (5, long, None, "b", len(long)), (None, "no id here at all today", "en", "a", 1), (None, None, None, None, None)]
    rows += [(6, "the same text of more than five words", "en", "a", 1)] * 2 + [(7, "The SAME text of more than five words", "en", "b", 1), (8, "é ü 漢字 Ω   \x85 \U0001f600", "de", "c", 1), (9, "a<|endoftext|>b <|startoftext|>", "en", "c", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names operators use themselves."""
    rows = [(*r, "x", 1, 2.0) for r in odd_rows()]
    return spark.createDataFrame(rows, DOCS + ", size string, taken int, score double").repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS).repartition(3)
