import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n", "one", "One two", "the quick brown fox jumps over the lazy dog again and again until night falls on the hill",
    "the quick brown fox jumps over the lazy dog again and again until night falls on the hill", "THE QUICK brown fox jumps over the lazy dog again and again until night falls on the hill",
    "prefix words here the quick brown fox jumps over the lazy dog again and again until night falls on the plain", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a",
    "naïve café 🙂 straße joined wide", "line one\nline two\r\n\nline four\n", LONG, LONG + " tail", "x" * 5000,
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all but some words in a row that are long enough to be a window of thirteen", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    extra = {n: 1 for n in ("size", "target", "score", "fp", "node", "key", "ids", "code_", "page", "start")}
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(v) for n, v in extra.items()})


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
