import pytest
from pyspark.sql import types as T

ODD_DOCS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "three four five"), (None, None),
    (6, "Ümläut çédille 東京 words and more words"), (7, "word " * 30_000), (8, "x" * 200_000),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with sources, and columns whose names operators use themselves."""

    def make(rows, source=lambda i: f"s{i % 3}"):
        schema = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
            *[T.StructField(c, T.StringType()) for c in ("key", "kept", "_in0", "bands", "component", "sid", "spans", "good", "batch")],
        ])
        full = [(i, t, "en", source(k), None if t is None else len(t), *["extra"] * 9) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    return docs_of(ODD_DOCS)


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])
