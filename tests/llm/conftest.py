import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables absent")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows, a text without letters, a clashing extra column."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c\nd e f\ng h i", "en", "s", 17),
            (3, "a b c\nd e f\ng h i", "en", "s", 17), (4, "12 34 !!", None, "s", 8), (None, "the text of no key", "en", None, 18),
            (5, "word " * 60_000, "en", "s", 300_000), (6, "x" * 20_000, "de", "s", 20_000), (7, " \n\t\n ", "en", "s", 5),
            (8, "\n\n\n\n", "en", "s", 4), (9, "日本語のテキスト 😀 é", "ja", "s", 13)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS + ", key string, fp int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
