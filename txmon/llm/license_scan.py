"""Licence scan, DataFrame functions only: TF-IDF cosine to templates, then nearest-ancestor inheritance.

1. Candidate statements of a file are its lines with a licence cue, each such line's sentences, the line with the two
   lines after it, and the paragraph it stands in (headers are wrapped, titles have their version on the next line); of licence files
   also the whole text. Equal statements are scored once, however often they occur.
2. A statement's terms, weighted by inverse document frequency over the templates, are joined with the templates'
   sparse vectors (``license_templates``). Spellings of versions are brought to one form, what follows a copyright sign is left out, and a template
   that names a version only counts if the statement holds it. Of the templates of a cosine of ``min_cosine`` or more the most specific is the
   file's own licence, among those the one of the greatest cosine.
3. A directory's licence comes from its licence files. Each distinct directory of files without one of their own is joined by path
   with its ancestors' licences; the deepest wins.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.llm.common import ROW, materialize, pack, text_of, unpack
from txmon.llm.license_templates import Template, templates

CUE = (r"(?i)licen[cs]e|copyright|spdx|creative commons|public domain|all rights reserved|permission (is|to use)|redistribution and use"
       r"|endorse or promote|proprietary|\bcc[ -](by|0)|\bcc0|\b[al]?gpl|free software")
LICENCE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|unlicense|notice|copyright)([._-][^/]*)?$"
MIN_COSINE = 0.6

#: A blank line, or one with nothing but comment marks, ends a paragraph.
_PARAGRAPH = r"\n[\s*#/;%-]*(?=\n)"


def terms_of(statement: Column) -> Column:
    """Terms of a statement: words and numbers; ``v2.0``, ``2.0`` and ``2`` are one, as are GPLv2 and GPL 2, licence and license."""
    text = F.regexp_replace(F.lower(statement), "licenc", "licens")
    holder = r"(copyright\s*)?(\(c\)|\u00a9|copyright\s+(?=[0-9]{4}))[^\n]*?(all rights reserved|\n|$)"
    text = F.regexp_replace(text, holder, "copyright $3 ")
    text = F.regexp_replace(text, r"\b([al]?gpl|mpl|apache|cc|epl)-?v?(?=[0-9])", "$1 ")
    words = F.regexp_extract_all(text, F.lit(r"([a-z0-9]+(?:\.[0-9]+)*)"), F.lit(1))
    return F.transform(words, lambda w: F.regexp_replace(w, r"^v(?=[0-9])|(?<=[0-9])(\.0)+$", ""))


def template_vectors(spark: SparkSession, given: list[Template]) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(whole, template, term, unit weight, needed), (term, idf), (template, licence, rank, needs) and the idf of any other term.
    The templates are a parameter of a few hundred short texts: their vectors pass the driver."""
    frame = spark.createDataFrame([(k, t.text) for k, t in enumerate(given)], "template int, text string")
    counts = {r.template: Counter(r.terms) for r in frame.select("template", terms_of(F.col("text")).alias("terms")).collect()}
    n = len(given)
    df = Counter(term for own in counts.values() for term in own)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in sorted(df.items())}
    rows = []
    for k, own in sorted(counts.items()):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in own.items()))
        rows += [(given[k].whole, k, t, c * idf[t] / norm, int(t in given[k].need)) for t, c in sorted(own.items())]
    return (spark.createDataFrame(rows, "whole boolean, template int, term string, w double, needed int"),
            spark.createDataFrame(list(idf.items()), "term string, idf double"),
            spark.createDataFrame([(k, t.licence, t.rank, len(t.need)) for k, t in enumerate(given)], "template int, licence string, rank int, needs int"),
            math.log(1 + n) + 1)


def best_templates(statements: DataFrame, given: list[Template], min_cosine: float) -> DataFrame:
    """(sid, best: rank, cosine, licence) of the distinct ``statements(sid, statement, whole)`` that are close enough to a template.

    Terms carry the short statement id, never the statement, which can be a whole long file.
    """
    weights, idfs, names, other = template_vectors(statements.sparkSession, given)
    terms = (
        statements.select("sid", "whole", F.explode(terms_of(F.col("statement"))).alias("term"))
        .groupBy("sid", "whole", "term").agg(F.count("*").alias("tf"))
        .join(idfs, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    )
    known = F.col("idf").isNotNull()
    # a cosine cannot exceed the share of the statement's length that lies in the templates' terms: prose goes here
    norms = (terms.groupBy("sid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sqrt(F.sum(F.when(known, F.col("x") * F.col("x")))).alias("held"))
             .filter(F.col("held") >= F.col("norm") * (min_cosine - 1e-6)).select("sid", "norm"))
    dots = (terms.filter(known).join(norms, "sid").join(weights, ["whole", "term"]).groupBy("sid", "norm", "template")
            .agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.sum("needed").alias("held")))
    return (
        dots.join(names, "template").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
        .filter((F.col("cosine") >= min_cosine) & (F.col("held") >= F.col("needs")))
        .groupBy("sid").agg(F.max(F.struct("rank", "cosine", "licence")).alias("best"))
    )


#: Every cue holds one of these, lower-cased: a quick look at the texts without any.
_HINTS = ("license", "licence", "copyright", "spdx", "commons", "public domain", "reserved", "permission", "redistribution", "endorse",
          "proprietary", "cc by", "cc-by", "cc 0", "cc-0", "cc0", "gpl", "free software")


def hinted(low: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in _HINTS])


def statements_of(text: Column) -> Column:
    """Lines with a cue, their sentences, the line with the next two, and the paragraphs with a cue."""
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"\S"))
    rest = [F.slice(lines, k, F.greatest(F.size(lines), F.lit(1))).alias(f"n{k}") for k in (2, 3)]
    cued = F.filter(F.arrays_zip(lines.alias("n1"), *rest), lambda z: z["n1"].rlike(CUE))

    def of_line(z: Column) -> Column:  # one pass: an expression inside a lambda is evaluated for each element
        parts = F.filter(F.split(z["n1"], r"[.;:!?]\s+"), lambda x: x.rlike(CUE))
        return F.concat(F.array(z["n1"], F.concat_ws("\n", z["n1"], z["n2"], z["n3"])), parts)

    paragraphs = F.filter(F.split(text, _PARAGRAPH), lambda x: x.rlike(CUE))
    return F.array_distinct(F.transform(F.concat(F.flatten(F.transform(cued, of_line)), paragraphs), lambda x: F.trim(x)))


def parent(path: Column) -> Column:
    """The directory of a path; the top directory is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None,
                 given: list[Template] | None = None, min_cosine: float = MIN_COSINE, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``files`` (``carry`` columns, default all) plus license, license_cosine, license_via, license_dir.

    license_via is ``own`` (a statement in the file), ``inherited`` (from the nearest ancestor directory, given in
    license_dir, that holds a licence file) or ``none`` (license is null). ``licence_file`` tells which files speak for their
    directory (default: by name); if several do, the most specific, then the greatest cosine, then the last name in order. Null texts are
    empty, a null path lies in the top directory; repeated rows each get their own answer; an empty table gives an empty result.
    Input columns named like the added ones are replaced.
    """
    carry = files.columns if carry is None else carry
    shape = files.select(*[f"`{c}`" for c in carry]).schema
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit(""))
    speaks = F.coalesce(path.rlike(LICENCE_FILE) if licence_file is None else licence_file, F.lit(False))
    none = F.array().cast("array<struct<statement:string,whole:boolean>>")
    text = F.col("_text")
    own = F.transform(statements_of(text), lambda x: F.struct(x.alias("statement"), F.lit(False).alias("whole")))
    own = F.when(F.col("_hint") & text.rlike(CUE), own).otherwise(none)
    own = F.when(F.col("_speaks"), F.concat(own, F.array(F.struct(text.alias("statement"), F.lit(True).alias("whole"))))).otherwise(own)
    rows = materialize(
        pack(files, carry, _dir=parent(path), _speaks=speaks, _text=text_of(f"`{text_col}`"))
        .withColumn("_low", F.lower("_text")).withColumn("_hint", hinted(F.col("_low")))  # lower case once, not once a hint
        .select(ROW, "_dir", "_speaks", own.alias("_said")).withColumn("_uid", F.monotonically_increasing_id()), "op6-files")
    said = rows.select("_uid", "_dir", "_speaks", F.explode("_said").alias("s")).select("_uid", "_dir", "_speaks", "s.*")
    said = said.withColumn("sid", F.md5(F.concat(F.col("whole").cast("string"), "statement")))
    known = materialize(best_templates(said.select("sid", "statement", "whole").dropDuplicates(["sid"]), given or templates(), min_cosine), "op6-statements")
    own = materialize(
        said.drop("statement").join(known, "sid").groupBy("_uid")
        .agg(F.max("best").alias("_own"), F.first("_dir").alias("_dir"), F.first("_speaks").alias("_speaks")), "op6-own")
    spoken = materialize(own.filter("_speaks").groupBy(F.col("_dir").alias("_from")).agg(F.max("_own").alias("_said")), "op6-directories")
    # every directory once, with itself and all directories above it
    steps = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("at")))
    above = F.array_union(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at"))), above)
    inherited = (
        rows.select("_dir").distinct().select("_dir", F.explode(above).alias("_up"))
        .join(spoken, F.col("_up.at") == F.col("_from"))
        .groupBy("_dir").agg(F.max(F.struct("_up.depth", "_from", "_said")).alias("_near"))
    )
    inherited = materialize(inherited, "op6-inherited")
    out = (
        rows.select(ROW, "_uid", "_dir").join(own.select("_uid", "_own"), "_uid", "left")
        .join(inherited, "_dir", "left")
        .withColumn("_best", F.coalesce("_own", "_near._said"))
    )
    via = F.when(F.col("_own").isNotNull(), "own").when(F.col("_near").isNotNull(), "inherited").otherwise("none")
    return unpack(out, shape, {
        "license": F.col("_best.licence"), "license_cosine": F.col("_best.cosine"), "license_via": via,
        "license_dir": F.when(F.col("_own").isNull(), F.col("_near._from"))})
