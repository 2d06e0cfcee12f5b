import pytest

LONG = "Lang ünd breit, the word of words " * 20_000

EDGES = [
    (1, "The cat sat on the mat. Licensed under the MIT License.", "en", "src0"),
    (2, None, "en", "src0"),
    (3, "", None, None),
    (4, " \n\t ", "xx", "src1"),
    (5, LONG, "de", "src0"),
    (6, "The cat sat on the mat. Licensed under the MIT License.", "en", "src0"),
    (7, "The cat sat on the mat. Licensed under the MIT License.", "en", "src0"),
    (7, "The cat sat on the mat. Licensed under the MIT License.", "en", "src0"),
    (None, "no id here, İstanbul ΣΑΣ 日本語 \U0001f600 é", "en", "src2"),
    (8, "one", "en", "src9"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row."""
    return spark.createDataFrame(EDGES, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="session")
def clashing(edges):
    """Extra columns with the names that operators add."""
    names = ["kept", "n_words", "n_tokens", "score", "found", "bands", "set_key", "token", "words", "held_out", "share", "probability", "weight", "toxic", "label", "start", "band", "component", "n", "i"]
    from pyspark.sql import functions as F

    return edges.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
