"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

Every document gets a uniform number from a seeded hash of its id; the inverse Poisson
distribution function with mean ``target rows of its source / rows of its source`` turns that into
a count, the document is exploded by the count, and the copies are shuffled globally by a second
hash. The choice for one document depends on nothing but its id, the seed and its source's rate, so a
retried task repeats it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmon.llm.common import ROW, materialize, pack, unpack

#: 13 hexadecimal digits of a digest: 52 bits, exact in a double.
_HEX, _SCALE = 13, float(1 << 52)


def hash_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts; a null part reads as ``null``."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(joined.cast("binary")), 1, _HEX), 16, 10).cast("double") + 0.5) / _SCALE


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below 2**-52."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    steps = F.transform(F.sequence(F.lit(1), last), lambda k: k.cast("double"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(steps, start, lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"),
    ))["cdf"]


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float], default_weight: float,
                 target_rows: int | None) -> DataFrame:
    """Per source: rows, normalised weight, rate (mean copies a row) and its distribution function.

    A source's share of the output is its weight over the weights of the sources present. Rates
    above 600 are split off into a whole part and a Poisson part, so that exp(-rate) stays exact.
    """
    w = F.lit(float(default_weight))
    for name, value in weights.items():
        w = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
    counts = materialize(docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_rows"))
                         .withColumn("_w", w), "op10-sources")
    sums = counts.agg(F.struct(F.sum("_rows").alias("n"), F.sum("_w").alias("w")).alias("s")).scalar()
    wanted = F.lit(float(target_rows)) if target_rows is not None else sums["n"].cast("double")
    rate = F.coalesce(F.try_divide(wanted * F.col("_w"), sums["w"] * F.col("_rows")), F.lit(0.0))
    out = counts.select("_source", "_rows", rate.alias("_rate"))
    out = out.withColumn("_whole", F.when(F.col("_rate") > 600, F.floor(F.col("_rate")) - 600).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("_cdf", poisson_cdf(F.col("_rate") - F.col("_whole")))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0,
                target_rows: int | None = None, id_col: str = "doc_id", source_col: str = "source",
                seed: int = 7) -> DataFrame:
    """Documents repeated by their Poisson count, in global hash order, plus copy_no, copies, mix_rate, mix_key.

    ``weights`` maps sources to relative target weights, others get ``default_weight``; a null
    source is a source of its own. ``target_rows`` (default: as many as came in) is the expected
    size of the output. Repeated rows with one id get the same count; a null id hashes as ``null``.
    Weight 0 drops a source. An empty table gives an empty result. Extra columns are carried; input
    columns named like the added ones are replaced.
    """
    shape = docs.schema
    rates = materialize(source_rates(docs, source_col, weights or {}, default_weight, target_rows), "op10-rates")
    u = hash_unit(F.col("_id"), F.lit(seed))
    picked = (
        pack(docs, docs.columns, _id=F.col(id_col), _src=F.col(source_col))
        .join(rates, F.col("_src").eqNullSafe(F.col("_source")), "left")
        .withColumn("_u", u)
        .withColumn("_n", F.col("_whole") + F.size(F.filter("_cdf", lambda c: c < F.col("_u"))))
        .filter("_n > 0")
        .select(ROW, "_id", "_rate", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
        .withColumn("_key", hash_unit(F.col("_id"), F.col("_copy"), F.lit(seed + 1)))
    )
    ordered = picked.orderBy("_key", "_id", "_copy")
    return unpack(ordered, shape, {"copy_no": F.col("_copy"), "copies": F.col("_n"), "mix_rate": F.col("_rate"),
                                   "mix_key": F.col("_key")})
