import pytest

#: Null, empty, blank, tiny, repeated and very long texts; null sources; a column for each working name of an operator.
LONG = "word " * 30_000 + "end"
TEXTS = [None, "", " \t\n", "a", "two words", "Repeated text of several words here.", "Repeated text of several words here.", "ÀÉ naïve façade — “quoted” 漢字 1½", LONG, "x\n\ny  z"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 3}", i) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "s1", 6), (None, "text without an id", None, 99), (None, None, None, None)]
    extra = ["size", "shard", "slot", "fp", "key", "rest", "full", "begin", "target", "score", "length", "rank", "n", "root", "tie", "span"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in extra}).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")
