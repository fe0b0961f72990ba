import pytest

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then some more words follow it.", "en", "s", 80),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "A row without an identifier has a text of its own, is it not so?", "en", "s", 1),
    (None, None, None, None, None),
    (5, LONG, "la", "s", len(LONG)),
    (6, "x" * 200_000, "", "", 1),
    (7, "same text twice with the same identifier here", "en", "s", 1),
    (7, "same text twice with the same identifier here", "en", "s", 1),
    (8, "same text twice with the same identifier here", "en", "s", 1),
    (9, "é😀 ﬁ½ ▁▁ <|endoftext|> <s>́ \t\x0b\n\n  two  blanks \x01", "zz", "s", 1),
    (10, "   ", "en", "s", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeats, and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("k", "h", "t", "y", "fold", "node", "digest", "_gone", "_seed", "_c0", "start", "row", "score", "key", "bucket")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
