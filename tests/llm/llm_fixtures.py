import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Rows no operator may stumble over: nulls, empty and very long texts, repeats, equal ids, odd characters.
HARD = [
    (0, "one two three four five six seven"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "ONE two Three four five six seven"),
    (5, "short"),
    (6, "emoji 😀 combining é nul\x00 nbsp end licence MIT License."),
    (7, "word " * 3000),
    (8, " ".join(f"w{i}" for i in range(400))),
    (9, "start " + " ".join(f"w{i}" for i in range(100, 300)) + " stop"),
    (9, "start " + " ".join(f"w{i}" for i in range(100, 300)) + " stop"),
    (10, " ".join(f"w{i}" for i in range(400))),
    (11, "idiot idiot idiot"),
    (12, "x" * 50_000),
    (13, "<|endoftext|> licensed under the Apache License, Version 2.0."),
    (None, "a row without an id one two three"),
    (None, None),
]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with extra columns whose names clash with outputs and internals."""
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    for c in ("score", "n_words", "kept_text", "component_id", "key", "rank"):
        df = df.withColumn(c, F.lit("extra"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
