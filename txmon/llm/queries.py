"""The registered queries opN_<name>: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.llm.common import held_out, table, text_of


#: Documents score 0.3 or more to stay.
QUALITY_THRESHOLD = 0.3
#: Numeric metadata of documents that the quality model may see.
QUALITY_META = ["n_chars"]


def quality_model(docs: DataFrame, labels: DataFrame):
    """The quality model, fitted without the held-out fold (crc32 of the id mod 5 is 0)."""
    from txmon.llm.quality_fm import train

    learn = labels.filter(~held_out("doc_id", 5) & F.col("doc_id").isNotNull())
    return train(docs, learn, "doc_id", "text", "quality", QUALITY_META)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.quality_fm import quality_scores

    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    found = quality_scores(docs, model, meta_cols=QUALITY_META, threshold=QUALITY_THRESHOLD, carry=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", "predicted")


def op2_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of documents; the digest column is the contract's and rides along as a payload."""
    from txmon.llm.exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(text_of("text"), 256))
    found = exact_dedup(docs, carry=["doc_id", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from txmon.llm.lattice_lm import lattice_scores

    held = held_out("doc_id", 10)
    found = lattice_scores(table(spark, sf_dir, "documents"), ~held, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return found.withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every benchmark item found in a document."""
    from txmon.llm.lsa_decontam import mark_leaks

    found = mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("x")).select(
        "doc_id", "x.item_id", F.round("x.cosine", 4).alias("cosine"), "x.lcs_share", "x.answer_share")


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), carry=["doc_id"], shingle=4, max_bits=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents as files ``source/lang/<doc_id div 1000>/<doc_id div 100>/<doc_id>``.

    The table has no file names. A document that closes with its licence line stands for the licence file of its
    thousand: it is named LICENSE-<doc_id> and lies one directory higher.
    """
    from txmon.llm.license_scan import CUE, license_scan

    name, hundreds, thousands = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 100), F.floor(F.col("doc_id") / 1000)
    closes = F.substring_index(text_of("text"), "\n", -1).rlike(CUE)
    path = F.concat_ws("/", "source", "lang", thousands.cast("string"),
                       F.when(closes, F.concat(F.lit("LICENSE-"), name)).otherwise(F.concat_ws("/", hundreds.cast("string"), name)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return license_scan(docs, carry=["doc_id", "path"]).select("doc_id", "path", "license", "license_cosine", "license_via", "license_dir")


def op7_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.html_extract import extract_text

    return extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op8_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from txmon.llm.token_count import token_counts

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Target weights of the mixing query: the hot source counts half, two small ones double, all others one.
MIX_WEIGHTS = {"src0": 0.5, "src1": 2.0, "src2": 2.0}


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and shuffled; the digest of the text is taken from the mixed rows."""
    from txmon.llm.poisson_mix import poisson_mix

    found = poisson_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return found.select("doc_id", "source", "copy_no", "copies", F.round("mix_rate", 9).alias("mix_rate"), "mix_key",
                        F.md5(text_of("text").cast("binary")).alias("text_md5"))


#: (host, path, verdict) of the pages query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.url_filter import url_verdicts

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_verdicts(table(spark, sf_dir, "pages"), rules, carry=["page_id"])
    return found.select("page_id", "host", "path", "rule", "verdict")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of the contract: where h = crc32(doc_id) ends in 0, the words from a on repeat with period p."""
    words = F.regexp_extract_all(text_of("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = (docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
            .withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long")))  # null: the text stays as it is
            .withColumn("a", F.col("g") % F.col("n"))
            .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p + 1 as int)))), ' ')")
    return rows.select("doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(repeated).alias("text"))


def op12_run_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; the digest columns are the contract's."""
    from txmon.llm.run_finder import find_runs

    found = find_runs(with_repeats(table(spark, sf_dir, "documents")), carry=["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txmon.llm.source_audit import source_audit

    return source_audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_fm, op2_progressive_exact_dedup, op3_lattice_likelihood, op4_lsa_decontamination, op5_simhash_pigeonhole, op6_license_scan, op7_text_tag_ratio, op8_whole_token_counts, op9_suffix_array_dedup, op10_poisson_mix, op11_url_filter, op12_run_finder, op13_source_audit)}
