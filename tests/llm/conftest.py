import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} text{i % 53}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from here today", "en", "a", 1, "x"),
        (2, None, "en", None, None, None),
        (3, "", None, "a", 0, "x"),
        (4, " \t\n\r ", "de", "b", 4, "x"),
        (5, "one", "de", "b", 3, "x"),
        (6, long, "en", "b", len(long), "x"),
        (7, long + " end", "en", "b", len(long), "x"),
        (None, "a text without an id but with some words in it that are long enough", "fr", "b", 1, None),
        (8, "the quick brown fox jumps over the lazy dog and runs away from here today", "en", "c", 1, "x"),
        (8, "the quick brown fox jumps over the lazy dog and runs away from here today", "en", "c", 1, "x"),
        (9, "é́ 日本語 テキスト   x ### %%%   y", "ja", "c", 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)
