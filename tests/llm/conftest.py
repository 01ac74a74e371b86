import pytest
from pyspark.sql import types as T

from brindle import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with ids in order unless given."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(spark, docs_of):
    """Nulls, blanks, a very long text, ties, repeated rows, a null id, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = ["one two three four five six", "", None, "   \n\t ", long_text, "one two three four five six", "short", "same id", "other text of the same id", "same id", "no id here"]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, None]
    df = docs_of(texts, ids)
    extra = ["label", "score", "predicted", "fingerprint", "spans", "ids", "decoded", "removed", "words", "hash", "key", "item_id", "component_id", "weight", "index"]
    return df.withColumns({c: F.lit("mine") for c in extra})
