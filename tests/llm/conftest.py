import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use inside
CLASHING = SCHEMA + ", fp long, h long, did long, y int, score double, n int, spans string, root long, key long, cell int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, an empty and a very long text, ties, a repeated
    row, and extra columns with clashing names."""
    long_text = " ".join(f"w{i % 997}x{i % 31}" for i in range(120_000))
    rows = [(1, "alpha beta gamma", "en", "s", 16), (2, None, None, None, None), (None, "lost id text here", "en", None, 17),
            (3, "", "en", "s", 0), (4, long_text, "en", "s", len(long_text)), (5, "alpha beta gamma", None, "s", 16),
            (5, "alpha beta gamma", None, "s", 16), (6, " \t\n ", "de", "s", 4), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 7, 7, 7, 1, 0.5, 3, "x", 9, 9, 1) for r in rows], CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
