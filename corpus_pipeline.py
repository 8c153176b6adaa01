"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, mixing.

Each stage takes the documents that its predecessor wrote and applies one operator of ``txmon.llm``;
all but the last return the columns of documents.

What holds for every stage: a document travels whole, as one struct, through the operator, and only the columns that the
operator reads stand beside it (found by name, in any case); its decisions are read before the struct is opened again. So extra columns keep their
names and values, whatever an operator calls its own. Null and empty texts are texts, a null id is an id, repeated rows are rows
of their own, and an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.llm.common import materialize, table
from txmon.llm.exact_dedup import exact_dedup
from txmon.llm.lsa_decontam import mark_leaks
from txmon.llm.poisson_mix import poisson_mix
from txmon.llm.quality_fm import quality_scores
from txmon.llm.queries import MIX_WEIGHTS, QUALITY_META, QUALITY_THRESHOLD, quality_model
from txmon.llm.simhash import simhash_components

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The columns that operators read.
READ = ("doc_id", "text", "lang", "source", "n_chars")
DOCUMENT = "document"


def packed(docs: DataFrame) -> DataFrame:
    """The documents as one struct, beside the columns that operators read; one that is missing is null."""
    plain = docs.toDF(*[f"c{i}" for i, _ in enumerate(docs.columns)])  # by position: names may hold dots or differ in case only

    def column(name: str) -> Column:
        same = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name]
        return (F.col(f"c{same[0]}") if same else F.lit(None)).alias(name)

    return plain.select(F.struct("*").alias(DOCUMENT), *[column(name) for name in READ])


def unpacked(found: DataFrame, docs: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` again; ``added`` ones of the operator replace any of the same name, in any case."""
    own = [F.col(DOCUMENT)[f"c{i}"].alias(name) for i, name in enumerate(docs.columns) if name.lower() not in added]
    return found.select(*own, *added)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; the model never sees the held-out fold's labels.

    Empty and null texts are scored like any others; copies score alike, so all stay or all go."""
    rows = packed(docs)
    model = quality_model(rows, table(spark, sf_dir, "labels"))
    scored = quality_scores(rows, model, meta_cols=QUALITY_META, threshold=QUALITY_THRESHOLD, carry=[DOCUMENT])
    return unpacked(scored.filter("predicted = 1"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-identical texts the row with the largest doc_id stays; null and empty texts are identical, a null id is the smallest."""
    return unpacked(exact_dedup(packed(docs), carry=[DOCUMENT]).filter("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (4 words, 4 bits) the one with the smallest doc_id stays; texts without words are linked."""
    return unpacked(simhash_components(packed(docs), carry=[DOCUMENT], shingle=4, max_bits=4).filter("stays"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts, and null and empty items, hold nothing."""
    return unpacked(mark_leaks(packed(docs), table(spark, sf_dir, "benchmark"), carry=[DOCUMENT]).filter(F.size("leaks") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by target weights of their sources, with copy_no, copies, mix_rate and mix_key; a null source is a source."""
    return unpacked(poisson_mix(packed(docs), MIX_WEIGHTS), docs, ("copy_no", "copies", "mix_rate", "mix_key"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix),
]

#: SQL cannot express the learned and iterative stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
