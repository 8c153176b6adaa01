"""The pipeline's stages take effect, one after the other, and keep the columns of documents."""
import corpus_pipeline as pipeline
from txmon.llm.common import table


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        kept[name] = docs
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in kept.items()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mix"]
    for before, after in zip(names[:-1], names[1:-1]):
        assert set(ids[after]) < set(ids[before]) and len(set(ids[after])) == len(ids[after])
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    bad = [i for i, q in labels.items() if q == 0]
    assert len(set(bad) & set(ids["quality_classifier"])) < 0.15 * len(bad)
    assert sum(labels.get(i) == 1 for i in ids["quality_classifier"]) > 0.97 * sum(q == 1 for q in labels.values())
    texts = [r.text for r in kept["exact_dedup"].collect()]
    assert len(set(texts)) == len(texts) == len({r.text for r in kept["quality_classifier"].collect()})
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert not [1 for r in kept["benchmark_decontamination"].collect() if any(t in r.text for t in items)]
    assert set(ids["source_mix"]) <= set(ids["benchmark_decontamination"])
    run = pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in run.select("doc_id").collect()) == sorted(ids["source_mix"])


# --- odd tables ---------------------------------------------------------------------------------

#: Extra columns named like what operators add or use, in several cases, with dots and reserved words.
OWN = ["Kept", "STAYS", "predicted", "Score", "leaks", "a.b", "document", "c0", "_row", "_id", "Copies", "mix_rate", "keep_id", "select"]


def odd_tables(spark, folder, n_docs=None):
    """The small tables with odd rows and clashing columns, as a folder of tables."""
    from pyspark.sql import functions as F

    from tests.llm.conftest import DOC_SCHEMA, ODD

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    good = [r.doc_id for r in table(spark, sf, "labels").filter("quality = 1").orderBy("doc_id").limit(3).collect()]
    copies = docs.filter(F.col("doc_id").isin(good)).withColumn("doc_id", F.col("doc_id") + 10 ** 9)
    odd = spark.createDataFrame([(i and i + 10 ** 10, t, None if k % 2 else "en", None if k % 3 else "src0", k if k % 4 else None) for k, (i, t) in enumerate(ODD)], DOC_SCHEMA)
    rows = docs.unionByName(copies).unionByName(copies).unionByName(odd)
    if n_docs is not None:
        rows = rows.limit(n_docs)
    rows = rows.select(*[F.col(c).alias(c.upper() if c == "source" else c) for c in rows.columns],
                       *[F.concat(F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in OWN])
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    table(spark, sf, "labels").write.parquet(f"{folder}/labels.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return rows, good


def test_odd_rows_and_clashing_columns_through_run(spark, tmp_path):
    folder = str(tmp_path / "odd")
    rows, good = odd_tables(spark, folder)
    docs, columns = table(spark, folder, "documents"), rows.columns
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        got = docs.collect()
        for r in got:
            assert all(r[5 + k] == f"own {c} {r.doc_id if r.doc_id is not None else 'null'}" for k, c in enumerate(OWN)), name
        assert {r.doc_id for r in got} <= before
        docs = spark.createDataFrame([tuple(r) for r in got], docs.schema)
        if name == "exact_dedup":
            texts = [r.text or "" for r in got]
            assert len(texts) == len(set(texts))
            kept = {r.doc_id for r in got}
            assert not any(i in kept for i in good) and sum(i + 10 ** 9 in kept for i in good) >= 2  # the largest id of a copy stays, once
    mixed = pipeline.run(spark, folder)
    lower = [c.lower() for c in mixed.columns]
    assert len(set(lower)) == len(lower) and lower[-4:] == ["copy_no", "copies", "mix_rate", "mix_key"]
    assert set(c.lower() for c in columns) - {"copies", "mix_rate"} <= set(lower)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in mixed.collect()} <= ids and mixed.filter(f"`a.b` <> concat('own a.b ', coalesce(cast(doc_id as string), 'null'))").count() == 0


def test_empty_table_through_run(spark, tmp_path):
    folder = str(tmp_path / "empty")
    odd_tables(spark, folder, 0)
    assert pipeline.run(spark, folder).count() == 0


def test_a_name_in_two_cases_is_read_by_the_exact_one(spark):
    import pytest

    df = spark.createDataFrame([(1, "upper", "lower")], "doc_id long, TEXT string, t string").toDF("doc_id", "TEXT", "text")
    row = pipeline.packed(df).first()
    assert (row.text, row.source) == ("lower", None)
    assert pipeline.unpacked(pipeline.packed(df), df).columns == ["doc_id", "TEXT", "text"]
    with pytest.raises(Exception):
        df.select("text").collect()  # why names are matched by position
