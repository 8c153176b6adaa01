"""Skew-safe ordered computations per key: running totals and "previous row" values.

``Window.partitionBy(key)`` sends every row of a key to one task, so a key holding a third of
the data becomes one huge sort. Both helpers split each key into ordered *segments* (a
monotone bucket of the ordering column, e.g. the hour of a timestamp) and:

1. compute the per-segment result with a window over ``(key, segment)`` (many tasks per key);
2. aggregate one row per ``(key, segment)`` (partial aggregation before the shuffle);
3. carry the previous segments' contribution with a window over that small table;
4. join the carry back on ``(key, segment)`` (same keys as step 1, so no extra shuffle).

Results are exact; the segment only decides how the work is split.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEG = "_seg"


# Segments per doubling of a numeric ordering value (about 1 % of relative range each).
LOG_SEGMENTS_PER_DOUBLING = 64
# Equal parts of a numeric column's own range.
RANGE_SEGMENTS = 4096


def default_segment(df: DataFrame, order_col: str) -> Column:
    """A monotone bucket of the first ordering column.

    Timestamps: the hour (a key holding a third of 100 TB over seven years is ~0.5 GB per hour,
    a right-sized task; the carry table has one small row per active key-hour). Dates: the day.
    Numbers: two monotone buckets together: ``floor(64 * sign(v) * log2(1 + |v|))``, which copes with outliers,
    and 4096 equal parts of the finite data's own [min, max] (a one-row aggregate as a scalar subquery), which
    splits a narrow range such as epoch numbers or doubles close together; infinities and NaN have the outermost ones. Other types: a single segment
    (plain window per key)."""
    dt = df.schema[order_col].dataType
    c = F.col(order_col)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.date_trunc("day", c.cast("timestamp"))
    if isinstance(dt, T.NumericType):
        largest = F.lit(sys.float_info.max)
        v = F.when(c.isNotNull(), F.greatest(F.least(c.cast("double"), largest), -largest))  # infinities in the outermost segments
        finite = F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= largest), v)
        seen = df.select(F.struct(F.min(finite).alias("lo"), F.max(finite).alias("hi"))).scalar()
        part = F.try_divide(v / 2 - seen["lo"] / 2, seen["hi"] / 2 - seen["lo"] / 2) * F.lit(float(RANGE_SEGMENTS))
        linear = F.floor(F.least(F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), F.lit(RANGE_SEGMENTS - 1.0)))
        doubling = F.floor(F.lit(float(LOG_SEGMENTS_PER_DOUBLING)) * F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)))
        # NaN orders above every number
        return F.when(F.isnan(c.cast("double")), F.lit(LOG_SEGMENTS_PER_DOUBLING * 1025)).otherwise(doubling) * RANGE_SEGMENTS + linear
    return F.lit(0)


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                 extra: Column | None = None) -> DataFrame:
    """Null-safe equi-join on ``keys`` (NULL keys match each other), keeping the left key
    columns. The right keys are renamed first, so frames derived from the same source join
    without ambiguity; ``extra`` is an additional condition on the (unique) column names."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    conds = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + ([extra] if extra is not None else [])
    cond = reduce(lambda a, b: a & b, conds)
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])




def _default_of(dtype: T.DataType):
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.lit("1970-01-01").cast(dtype)
    return None


def _with_key_surrogates(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Replace each key by two never-NULL columns (value-or-default, is-null), so NULL keys form
    their own group and plain equi-joins and windows on the *same* columns line up: the join's
    output partitioning then satisfies the window and the big side is shuffled once."""
    names, cols = [], {}
    for i, k in enumerate(by):
        d = _default_of(df.schema[k].dataType)
        if d is None:  # e.g. struct keys: keep as is (NULL-safe join below handles them)
            names.append(k)
            continue
        cols[f"_kv{i}"] = F.coalesce(F.col(k), d)
        cols[f"_kn{i}"] = F.col(k).isNull()
        names += [f"_kv{i}", f"_kn{i}"]
    return df.withColumns(cols), names


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str,
                segment: Column | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same ``by`` key up to and including this
    row in ``order`` (ties in ``order`` must be broken by the caller, e.g. with an id)."""
    seg = segment if segment is not None else default_segment(df, order[0])
    d, kcols = _with_key_surrogates(df.withColumn(SEG, seg), list(by))
    keys = kcols + [SEG]
    totals = d.groupBy(*keys).agg(F.sum(value).alias("_segsum"))
    before = Window.partitionBy(*kcols).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.sum("_segsum").over(before).alias("_carry"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cond = [F.col(k) == F.col(f"_c{k}") for k in keys] if all(k.startswith("_k") or k == SEG for k in keys) \
        else [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys]
    j = d.join(carry, cond, "left").drop(*[f"_c{k}" for k in keys])
    # NULLs add nothing; the sum is NULL only while no value has been seen, as in a plain window
    vt = df.schema[value].dataType
    zero = F.lit(0).cast(vt) if isinstance(vt, T.NumericType) else F.lit(0)
    here = F.sum(value).over(within)
    both = F.when(F.col("_carry").isNotNull() | here.isNotNull(), F.coalesce(F.col("_carry"), zero) + F.coalesce(here, zero))
    return j.withColumn(out, both).drop("_carry", SEG, *[k for k in kcols if k.startswith("_k")])


def previous_value(df: DataFrame, by: list[str], order: list[str], col: str, out: str,
                   segment: Column | None = None) -> DataFrame:
    """``out`` = ``col`` of the previous row of the same key in ``order`` (NULL for the first).

    ``col`` must be non-decreasing in ``order`` within a key (e.g. the ordering timestamp
    itself): then the last row of a segment holds the segment's maximum.
    """
    seg = segment if segment is not None else default_segment(df, order[0])
    d, kcols = _with_key_surrogates(df.withColumn(SEG, seg), list(by))
    keys = kcols + [SEG]
    last = d.groupBy(*keys).agg(F.max(col).alias("_seglast"))
    prev_seg = Window.partitionBy(*kcols).orderBy(SEG)
    carry = last.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.lag("_seglast").over(prev_seg).alias("_carry"))
    within = Window.partitionBy(*keys).orderBy(*order)
    cond = [F.col(k) == F.col(f"_c{k}") for k in keys] if all(k.startswith("_k") or k == SEG for k in keys) \
        else [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys]
    j = d.join(carry, cond, "left").drop(*[f"_c{k}" for k in keys])
    return (j.withColumn(out, F.coalesce(F.lag(col).over(within), F.col("_carry")))
             .drop("_carry", SEG, *[k for k in kcols if k.startswith("_k")]))
