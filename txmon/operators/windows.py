"""Ordered computations: running totals (W1), activity gaps (W2) and shares of total.

W1/W2 go through the skew-safe segmented helpers; W3 divides by a scalar-subquery total instead
of ``sum() OVER ()``, which would move every row into one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmon.operators.segmented import previous_value, running_sum


def cumulative(df: DataFrame, category: str, value: str, order: list[str],
               out: str = "cumulative_sum", segment: Column | None = None) -> DataFrame:
    """Running sum of ``value`` per category in ``order`` (make it unique, e.g. add an id)."""
    return running_sum(df, [category], order, value, out, segment)


def activity_gap(df: DataFrame, account: str, ts: str, id_col: str,
                 segment: Column | None = None) -> DataFrame:
    """Previous transaction time of the account and the gap in seconds."""
    p = previous_value(df, [account], [ts, id_col], ts, "prev_ts", segment)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / F.lit(1e6)
    return p.withColumn("gap_seconds", gap)


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Value / sum(value) over all rows (NULL when the total is 0)."""
    total = df.select(F.sum(value)).scalar()
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")))
