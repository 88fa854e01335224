import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, score string, h string, t string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tree near the quiet river today"
    texts = [None, "", " \n\t ", "x", "one two three", base, base, base + " again", long, long + " end", "a\x0bb c d e", "Ünïcödé ß É " + base.upper(), "only 12345 67 !!", "<|endoftext|> token=abcdef1"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "w", "s", "h", "t") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, "en", None, 3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(edge):
    return edge.filter(F.lit(False))


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
