"""Preview, bounded samples, top-k (L1-L5) and top-k per group.

Global top-k compiles to ``TakeOrderedAndProject`` (a bounded heap per partition, then one
merge of n rows per partition). Top-k per group uses ``row_number() <= n``, which Spark plans
with a partial ``WindowGroupLimit`` before the shuffle, so a hot group ships at most n rows
per map partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by, ascending: bool, tie) -> list[Column]:
    cols = [by] if isinstance(by, str) else list(by)
    ties = [] if tie is None else ([tie] if isinstance(tie, str) else list(tie))
    primary = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in cols]
    return primary + [F.col(t).asc() for t in ties]


def preview(df: DataFrame, n: int = 1000, order=None) -> DataFrame:
    """L1: ``TOP (n)`` rows; give ``order`` for a deterministic choice."""
    if order is None:
        return df.limit(n)
    cols = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in cols]).limit(n)


def bounded_sample(df: DataFrame, n: int, order, caveat_at: int = 40) -> DataFrame:
    """L2: first ``n`` rows in ``order`` plus the true row count of the whole input.

    ``total_rows`` is a scalar subquery (one extra aggregate job, no join), ``is_partial``
    says that rows were left out and ``needs_caveat`` that at least ``caveat_at`` are shown.
    """
    total = df.select(F.count(F.lit(1))).scalar()
    shown = F.least(total, F.lit(n).cast("long"))
    return (preview(df, n, order)
            .withColumn("total_rows", total)
            .withColumn("is_partial", total > F.lit(n))
            .withColumn("needs_caveat", shown >= F.lit(caveat_at)))


def top_n(df: DataFrame, n: int, by, tie, ascending: bool = False) -> DataFrame:
    """L3: ``nlargest``: top-n rows by ``by`` descending, NULLs last, ties by ``tie`` (required)."""
    if tie is None:
        raise ValueError("top_n needs a unique tie column for a deterministic result")
    return df.orderBy(*_order(by, ascending, tie)).limit(n)


def latest(df: DataFrame, ts: str, id_col: str, n: int = 5) -> DataFrame:
    """L4: the latest ``n`` rows by timestamp (ties by id)."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(id_col).asc()).limit(n)


def top_n_per_group(df: DataFrame, group, n: int, by, tie, ascending: bool = False,
                    rank_col: str = "rank") -> DataFrame:
    """Top-n rows per group (row_number over the group, ties by ``tie``)."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*_order(by, ascending, tie))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def count_categories(groups: DataFrame, col: str, count_nulls: bool = False) -> Column:
    """Number of values in a table of groups (one row per value) as a scalar subquery."""
    return groups.select(F.count(F.lit(1) if count_nulls else F.col(col))).scalar()


def limit_categories(df: DataFrame, col: str, value: str, max_categories: int | None = None, n: int = 10,
                     tie: str | None = None, count_nulls: bool = False, at_most: bool = False) -> DataFrame:
    """All rows; with ``max_categories``, only the top-``n`` rows by ``value`` once the column has that
    many distinct values or more (``at_most``: more than that many, the bar rule)."""
    k = count_categories(df.groupBy(col).agg(F.lit(1).alias("_one")), col, count_nulls)
    if max_categories is None:
        return df.withColumn("n_distinct", k)
    small = (k <= F.lit(max_categories)) if at_most else (k < F.lit(max_categories))
    many = top_n(df, n, value, tie or col).filter(~small)
    return df.filter(small).unionByName(many).withColumn("n_distinct", k)
