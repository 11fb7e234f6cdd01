import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
        (2, "the QUICK brown fox jumps over the lazy dog.", "en", "a", 44),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, LONG, "en", "b", len(LONG)),
        (5, LONG, "en", "b", len(LONG)),
        (6, "x", None, "b", 1),
        (None, "no id here at all", "de", "a", None),
        (7, "\t \n", "fr", "c", 3),
        (8, "ÄÖÜ straße ÉCOLE it's 12,3 <|startoftext|> 日本語", "de", "c", 40),
        (9, LONG + "omega", "en", "b", len(LONG) + 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name in ("uid", "name", "fp", "size", "copies", "node", "ref", "start", "length", "kept", "score", "_n", "_id", "part", "component"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
