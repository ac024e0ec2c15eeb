import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("good", T.StringType()),
        T.StructField("a b.c", T.StringType()),
    ]
)


def words(rng, n, most=400):
    return " ".join(f"w{rng.randrange(most)}" for _ in range(n))


def document_rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    texts = [words(rng, 80) for _ in range(25)]
    shared = words(rng, 90)
    texts += [texts[0]] * 6  # exact copies
    texts += [t.replace("w1", "W1", 1) for t in texts[:4]]  # near copies
    texts += [f"{words(rng, 20)}\n{shared}\n{words(rng, 20)}" for _ in range(5)]
    texts += ["", None, " \n\t ", "one", "two words", "ber " * 300, words(rng, 6000), "é漢字 ñ" * 40, "x" * 5000]
    texts += ["mail a.b@example.org or 10.0.0.1", "call +49 (30) 1234-5678 now", "4111 1111 1111 1111"]
    rows = []
    for i, text in enumerate(texts):
        source = None if i % 11 == 3 else ("hot" if i % 3 else f"s{i % 5}")
        rows.append((i, text, "en", source, i, "x", "x", "x", "x", "x", "x"))
    rows.append((None, texts[1], None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    rows += [rows[2], rows[2], rows[40]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(document_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows():
    return document_rows()
