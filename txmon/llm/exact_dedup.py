"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Each round only looks further at rows that the round before left in a group of two or more:

1. byte lengths are counted (one row per length after the map-side combine);
2. rows whose length repeats are grouped by (length, hash of a short prefix);
3. only rows in a surviving (length, prefix) group get a SHA-256 of the whole text.

All groupings are counts with map-side combine, so a group that holds a third of all rows is a few
rows per task after the first step. Both joins run against written tables, so adaptive execution
can broadcast them by measured size or split a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, materialize, pack, text_of, unpack

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """All rows of ``docs`` (the ``carry`` columns, default all) plus keep_id, group_size, kept, full_hash.

    Texts are equal when byte-identical; null equals empty. Of equal texts the row with the largest
    id stays; a null id loses against any other. Repeated rows (same id and text) are separate
    members: one of them is kept, group_size counts all. ``full_hash`` (SHA-256 hex) is null where
    an earlier round already proved the text unique. An empty table gives an empty result; extra
    columns are carried, and columns named like the added ones are replaced.
    """
    carry = docs.columns if carry is None else carry
    shape = docs.select(*[f"`{c}`" for c in carry]).schema
    text = text_of(text_col)
    base = pack(docs, carry, _id=F.col(id_col), _text=text, _len=F.octet_length(text),
                _prefix=F.xxhash64(F.substring(text, 1, prefix_chars)))

    lengths = base.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("_len")
    prefixes = materialize(
        base.select("_len", "_prefix").join(materialize(lengths, "op2-lengths"), "_len", "left_semi")
        .groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).filter("_n > 1"), "op2-prefixes")
    rows = materialize(
        base.join(prefixes, ["_len", "_prefix"], "left")
        .select(ROW, "_id", F.when(F.col("_n").isNotNull(), F.sha2(F.col("_text"), 256)).alias("_full"))
        .withColumn("_uid", F.monotonically_increasing_id()), "op2-rows")

    # null ids order below all others, so max() only picks one where a group has nothing else
    groups = materialize(
        rows.filter("_full IS NOT NULL").groupBy("_full")
        .agg(F.max(F.struct("_id", (-F.col("_uid")).alias("_u"))).alias("_best"), F.count("*").alias("_n")),
        "op2-groups")
    alone = rows.filter("_full IS NULL").select(
        ROW, "_full", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), F.lit(True).alias("_kept"))
    grouped = rows.filter("_full IS NOT NULL").join(groups, "_full").select(
        ROW, "_full", F.col("_best._id").alias("_keep"), "_n", (F.col("_uid") == -F.col("_best._u")).alias("_kept"))
    return unpack(alone.unionByName(grouped), shape, {
        "keep_id": F.col("_keep"), "group_size": F.col("_n"), "kept": F.col("_kept"), "full_hash": F.col("_full")})
