import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """A documents table from texts, or from (doc_id, text) pairs."""

    def make(rows, lang="en", source="s"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, lang, source, len(t) if t is not None else None) for i, t in rows], DOCS
        )

    return make


#: Texts that every operator must take: null, empty, white space, ties, repeats, control characters, very long.
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "one", "two words", "a\x00b", "Ä ß é \U0001f600   x", "w " * 30000, "x" * 50000]


@pytest.fixture
def odd_docs(docs_of):
    rows = list(enumerate(ODD)) + [(3, "one"), (None, None), (None, "no id")]
    return docs_of(rows)
