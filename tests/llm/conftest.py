import pytest
from pyspark.sql import functions as F

LONG = "long words " * 40_000


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, "The MIT License and the Apache License apply here.", "en", "a"),
        (2, "The MIT License and the Apache License apply here.", None, "a"),
        (2, "The MIT License and the Apache License apply here.", None, "a"),
        (3, None, "en", None),
        (4, "", "en", "b"),
        (5, " \n\t ", "fr", "b"),
        (None, "No id, but licensed under CC BY 4.0", "en", "c"),
        (6, "ÉTÉ Σίσυφος K licenKe ... cc-by! GNU general public LICENSE", "fr", "c"),
        (7, LONG, "en", "c"),
        (8, "one two three four five six seven eight nine ten eleven twelve", "en", "d"),
        (9, "x One Two three four FIVE six seven eight nine ten y", "en", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "words", "i", "w0", "t", "fp", "ck1", "size", "shard", "digit", "range", "first", "bucket", "score", "piece", "length", "prefix", "k1", "item", "start"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
