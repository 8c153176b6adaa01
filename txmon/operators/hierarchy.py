"""Hierarchies and per-location measures: sunburst, treemap, funnel, choropleth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _node_ids(path: list[str]):
    """node_id = present path values joined by '/', parent_id = the same without the last."""
    depth = F.lit(len(path)) - sum(F.grouping(c) for c in path)
    parts = [F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("(null)"))) for c in path]
    node = F.concat_ws("/", *parts)
    parent = F.concat_ws("/", *[F.when((F.grouping(c) == 0) & (F.lit(i + 1) < depth), F.coalesce(F.col(c).cast("string"), F.lit("(null)")))
                                 for i, c in enumerate(path)])
    return depth, node, parent


def sunburst(df: DataFrame, path: list[str], values: str) -> DataFrame:
    """Sum of ``values`` for every path prefix (ROLLUP without the grand total). The finest level is
    summed first and rolled up from its sums, so the rows themselves are not multiplied."""
    depth, node, parent = _node_ids(path)
    leaves = df.groupBy(*path).agg(F.sum(values).alias("_v"))
    out = leaves.rollup(*path).agg(F.sum("_v").cast(leaves.schema["_v"].dataType).alias("value"), depth.alias("depth"),
                                   node.alias("node_id"), parent.alias("parent_id"))
    return out.filter(F.col("depth") > 0)


def treemap(df: DataFrame, path: list[str], values: str, color: str) -> DataFrame:
    """As sunburst, plus the value-weighted mean of ``color`` per node (NULL for a node of weight 0)."""
    depth, node, parent = _node_ids(path)
    v = F.col(values).cast("double")
    leaves = df.groupBy(*path).agg(F.sum(values).alias("_v"), F.sum(F.col(color).cast("double") * v).alias("_cv"), F.sum(v).alias("_w"))
    out = leaves.rollup(*path).agg(F.sum("_v").cast(leaves.schema["_v"].dataType).alias("value"),
                                   F.try_divide(F.sum("_cv"), F.sum("_w")).alias("color"),
                                   depth.alias("depth"), node.alias("node_id"), parent.alias("parent_id"))
    return out.filter(F.col("depth") > 0)


def funnel(df: DataFrame, stage: str, value: str, order: str | None = None) -> DataFrame:
    """Value per stage in stage order; ``share_of_first`` = value / first stage's value (NULL if that is 0).
    Stage position is ``min(order)`` of its rows (``order`` defaults to the stage itself)."""
    o = order or stage
    g = df.groupBy(stage).agg(F.sum(value).alias("value"), F.min(o).alias("pos"))
    first = g.orderBy(F.col("pos").asc_nulls_last(), F.col(stage)).limit(1).select("value").scalar()
    return g.withColumn("share_of_first", F.try_divide(F.col("value").cast("double"), first.cast("double")))


def choropleth(df: DataFrame, location: str, measure: str, hover: str | None = None) -> DataFrame:
    """Measure summed per location code, with a hover name (smallest per location)."""
    aggs = [F.sum(measure).alias("value")]
    if hover:
        aggs.append(F.min(hover).alias("hover_name"))
    return df.groupBy(location).agg(*aggs)
