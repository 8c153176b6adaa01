"""How the sources of a language differ in their use of words: pairs of sources, and each source's telling terms.

Terms of a group (language, source) are ranked by count cells: terms with the same (count in the group, count in the language)
have the same value, so the value is computed once a cell, cells of equal value are merged, ordered by value, and their
cumulative multiplicity gives the rank at which each cell begins; only cells that begin within the wanted ranks are expanded to
terms, in UTF-8 order. Terms that are in no such cell are never sorted.

The distance of two sources sums over all kept terms of their language. Kept terms are dealt to blocks of about ``BLOCK_TERMS`` terms and, for
languages with more than ``TILE`` sources, to pairs of tiles of sources; a block adds up its distances in arrays of at most TILE
columns and emits one partial sum for each pair of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txmon.llm.common import lean, materialize, slices, text_of

#: Sources compared at once and kept terms per block.
TILE = 512
BLOCK_TERMS = 2048

#: Distinct (language, source, term) held by a task before they are passed on.
HELD = 400_000

SCALE = 1_000_000_000

#: A-Z become a-z, other ASCII a blank; bytes from 0x80 on stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (lang, source, term, count, documents), summed within the task while they fit."""
    lean()
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurs, docs) in held.items():
            n = len(occurs)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(list(occurs), pa.binary()),
                 pa.array(list(occurs.values()), pa.int64()), pa.array([docs[t] for t in occurs], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in slices(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
            terms = text.as_py().translate(_FOLD).split()
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
            occurs, docs = held[lang, source]
            size -= len(occurs)
            occurs.update(terms)
            docs.update(set(terms))
            size += len(occurs)
            if size >= HELD:
                yield from passed_on()
                size = 0
    yield from passed_on()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that hold it."""
    blank = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*blank, text_of(f"`{text_col}`").cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return (counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumn("term", F.col("term").cast("string")))


def smoothed(count: Column, total: Column, terms: Column, weight: int) -> Column:
    """1 + floor(SCALE * (count + weight) / (total + weight * terms)), exact."""
    wide = [x.cast("decimal(19,0)") for x in (count, total, terms)]
    above = (wide[0] + F.lit(weight)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (wide[1] + wide[2] * F.lit(weight)).cast("decimal(30,0)")) + F.lit(1).cast("long")


def _partial_distances(key: tuple, heads: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """Between the sources of tile ``a`` and of tile ``b``: what one block of terms adds to the distance that sources without any
    of these terms have."""
    lang, tile_a, tile_b, _block = key
    names = heads["source"].to_numpy(dtype=object)
    zero, tiles = heads["zero"].to_numpy(dtype=np.int64), heads["tile"].to_numpy()
    column = {s: k for k, s in enumerate(names)}
    rows, found = pd.factorize(terms["term"])
    p = np.tile(zero, (len(found), 1))
    p[rows, terms["source"].map(column).to_numpy(dtype=np.int64)] = terms["p"].to_numpy(dtype=np.int64)
    left, right = np.flatnonzero(tiles == tile_a), np.flatnonzero(tiles == tile_b)
    others = p[:, right]
    sums = np.array([np.abs(others - p[:, k:k + 1]).sum(axis=0) - len(found) * np.abs(zero[right] - zero[k]) for k in left], dtype=np.int64)
    out = pd.DataFrame({"lang": lang, "a": np.repeat(names[left], len(right)), "b": np.tile(names[right], len(left)), "part": sums.reshape(-1)})
    return out if tile_a == tile_b else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[out.columns]])


def _meets(rows: DataFrame) -> DataFrame:
    """Rows of sources, once for each pair (ta, tb) of tiles that their own tile is in."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    return (rows.withColumn("other", other)
            .withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other")).drop("other"))


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all ordered pairs of different sources of a language: abs(p - q) summed over its kept terms.

    ``kept``: lang, source, term, p of terms that occur in the group; ``groups``: lang, source, terms (kept ones of the language),
    zero (the p of a term that does not occur), tile and tiles (of the language).
    """
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("terms") / BLOCK_TERMS))
    heads = (_meets(groups.filter("terms > 0"))
             .select("lang", "ta", "tb", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", "zero", "tile"))
    terms = (_meets(kept.join(groups.select("lang", "source", "tile", "tiles", "terms"), ["lang", "source"]))
             .select("lang", "ta", "tb", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "p"))
    by = ["lang", "ta", "tb", "block"]
    sums = (heads.groupBy(*by).cogroup(terms.groupBy(*by))
            .applyInPandas(_partial_distances, "lang string, a string, b string, part long")
            .groupBy("lang", "a", "b").agg(F.sum("part").alias("value")))
    left = groups.select("lang", "terms", F.col("source").alias("a"), F.col("zero").alias("zero_a"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    nothing_held = F.when(F.col("terms") > 0, F.col("terms") * F.abs(F.col("zero_a") - F.col("zero_b"))).otherwise(0)
    return (left.join(right, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
            .select("lang", "a", "b", (nothing_held + F.coalesce("value", F.lit(0))).cast("long").alias("value")))


def telling_terms(kept: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, term, value, rank): terms more usual in the group than in its language, ranked by count cells.

    ``kept``: lang, source, term, n, in_lang, p, q of terms that occur in the group. Ranks up to ``ranks``.
    """
    group = ["lang", "source"]
    cells = (kept.groupBy(*group, "n", "in_lang").agg(F.count("*").alias("many"), F.first("p").alias("p"), F.first("q").alias("q"))
             .filter("p > q").select(*group, "n", "in_lang", "many", (F.col("p") - F.col("q")).alias("value")))
    cells = materialize(cells, "op13-cells")
    merged = cells.groupBy(*group, "value").agg(F.sum("many").alias("many"))
    down = Window.partitionBy(*group).orderBy(F.desc("value"))
    begins = (merged.withColumn("at", F.row_number().over(down)).filter(F.col("at") <= ranks)  # a value ranks at least one term
              .withColumn("before", F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("many"))
              .filter(F.col("before") < ranks).select(*group, "value", "before"))
    wanted = cells.join(begins, [*group, "value"]).select(*group, "n", "in_lang", "value", "before")
    within = Window.partitionBy(*group, "value", "before").orderBy("term")
    return (kept.join(wanted, [*group, "n", "in_lang"])
            .withColumn("at", F.row_number().over(within)).filter(F.col("at") <= ranks)
            .withColumn("rank", (F.col("before") + F.col("at")).cast("int")).filter(F.col("rank") <= ranks)
            .select(*group, "term", "value", "rank"))


def source_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 min_docs: int = 30, weight: int = 5, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank), every number exact.

    Terms are runs of ASCII letters and characters from U+0080 on, A-Z lower-cased. A language keeps its V terms that at least
    ``min_docs`` of its documents hold. A group (lang, source), or a whole language, gives a kept term that it holds ``count`` times
    ``p = 1 + floor(10^9 * (count + weight) / (N + weight * V))``, N its occurrences of all kept terms.

    Part ``pair``: one row for each other source of the language; value sums abs(p - q) over all kept terms (0 without any),
    all ranks. Part ``term``: kept terms that occur in the group and have p over the language's q; value p - q, ranks up to
    ``ranks``. Rank counts from 1 in each group and part by value descending, then item in UTF-8 order.

    Null text, lang and source count as empty texts; a group whose documents hold no term, or no kept one, has its pairs and
    no terms; a language with one source has no pairs. Repeated rows count as often as they occur. An empty table gives no rows.
    """
    blank = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    counts = materialize(term_counts(docs, text_col, lang_col, source_col), "op13-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialize(counts.select("lang", "source", "term", "n").join(vocabulary.select("lang", "term", "in_lang"), ["lang", "term"]), "op13-kept")
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = (docs.select(*blank).distinct()
              .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(langs, "lang", "left")
              .na.fill(0, ["total", "terms", "lang_total"])
              .withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE))
              .withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
              .withColumn("zero", F.when(F.col("terms") > 0, smoothed(F.lit(0), F.col("total"), F.col("terms"), weight))))
    groups = materialize(groups, "op13-groups")
    kept = (kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
            .withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("terms"), weight))
            .withColumn("q", smoothed(F.col("in_lang"), F.col("lang_total"), F.col("terms"), weight)))
    pairs = source_distances(kept.select("lang", "source", "term", "p"), groups)
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    ranked = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value",
                          F.row_number().over(order).cast("int").alias("rank"))
    terms = telling_terms(kept.select("lang", "source", "term", "n", "in_lang", "p", "q"), ranks)
    return ranked.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
