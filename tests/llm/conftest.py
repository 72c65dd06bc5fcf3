import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and white texts, ties, a repeated row, a long text, clashing names."""
    long_text = "\n".join(f"line {i} of a very long text {i * 7919 % 1000}" for i in range(4000))
    rows = [
        (1, "the same text here\nand a second line of words", "en", "b", 10), (2, "the same text here\nand a second line of words", "en", "b", 10),
        (3, None, None, None, None), (None, "no id for this text", "de", "a", 1), (5, "", "en", "a", 0), (6, " \t\n ", "en", None, 4),
        (7, long_text, "fr", "a", len(long_text)), (8, "x", "en", "c", 1), (8, "x", "en", "c", 1), (9, "émoji 😀 ß\u0085 A B", None, "é", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ("size", "target", "shard", "slot", "score", "copies", "key", "fp", "component_id", "removed_lines", "held_out", "word", "c")
    for c in clash:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("own"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def local(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)
