import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, repeated rows, ties, one long text.
HARD = [
    (1, "one two three four five six", "en", "a", 1),
    (2, "one two three four five six", "en", "a", 1),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "en", None, 0),
    (6, "Straße naïve <|endoftext|> a  b\n\nc 12,5 it's", "de", "b", 9),
    (6, "Straße naïve <|endoftext|> a  b\n\nc 12,5 it's", "de", "b", 9),
    (None, "no id here", "en", "a", 2),
    (None, None, None, None, None),
    (7, "w " * 30_000, "en", "c", 60_000),
    (8, "x" * 50_000, "en", "c", 50_000),
    (9, "a\nb\nc\nd\na\nb\nc\nx", "en", "c", 15),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def hard(make_docs):
    return make_docs(HARD)


@pytest.fixture(scope="session")
def clashing(hard):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ("fp", "key", "h", "bucket", "shard", "size", "score", "n", "row_id", "gone", "copies", "held", "words", "item_ids")
    return hard.withColumns({c: F.lit("taken") for c in names})


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
