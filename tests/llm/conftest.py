import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, repeated rows, a long text, and a column with a name that results use."""
    rows = [
        (1, None, None), (2, "", "en"), (3, "   \n", "en"), (4, "Ab ab", "en"), (4, "Ab ab", "en"), (None, "no id here at all", "en"),
        (5, "word " * 30_000, "fr"), (6, "12345 !!", "fr"), (7, "é" * 3000, None), (8, "a b c d e f g h i j", "en"), (9, "A B c d e f g h i j", "en"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return frame.withColumn("score", F.lit("x")).withColumn("n_chars", F.length("text").cast("bigint"))
