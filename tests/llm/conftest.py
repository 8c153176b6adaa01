import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use inside or add themselves; as extra input columns they must do no harm.
CLASHES = ["_row", "_id", "_uid", "_text", "g", "b", "kind", "word", "c", "value", "score", "kept", "spans", "leaks", "license", "component_id", "copies", "n_tokens", "a.b"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, in several partitions."""

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) of the small documents table."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


#: Nulls in any column, empty texts, ties and repeated rows, one very long text.
ODD = [(None, None), (None, ""), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, None), (8, ""), (9, "a b c d e"), (10, "Ünïcode ﬁ 漢字   x"),
       (11, "word " * 60000), (12, "x" * 200000), (13, "\x00\x01 \n\n\t"), (14, "one")]
