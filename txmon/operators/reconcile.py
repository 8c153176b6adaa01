"""Union of routes (U1), de-duplication (U2) and source/landed reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_routes(suspicious: DataFrame, normal: DataFrame) -> DataFrame:
    """Both routes back as one table (columns aligned by name, missing ones NULL)."""
    return (suspicious.withColumn("route", F.lit("suspicious"))
            .unionByName(normal.withColumn("route", F.lit("normal")), allowMissingColumns=True))


def dedup_earliest(df: DataFrame, id_col: str, ts: str, tie=()) -> DataFrame:
    """One row per id -- the one with the earliest ``ts``, then smallest ``tie`` columns
    (pass all columns for a total order).

    ``min_by`` is an aggregate with a map-side partial step, so an id with millions of copies
    is reduced before the shuffle instead of sorted in one task as a window would."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    others = [c for c in df.columns if c != id_col]
    key = F.struct(F.col(ts), *[F.col(c) for c in ties])
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(id_col).agg(F.min_by(row, key).alias("_r"), F.count(F.lit(1)).alias("n_copies")) \
             .select(id_col, "_r.*", "n_copies")


def reconcile(source: DataFrame, landed: DataFrame, id_col: str) -> DataFrame:
    """Per id, copies in source and landed and a status: matched / missing / extra /
    duplicated (more landed copies than source copies). Each side is counted per id first
    (partial aggregation), so the full outer join sees unique keys only."""
    s = source.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_source"))
    l_ = landed.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_landed"))
    j = s.join(l_, id_col, "full_outer").select(
        id_col, F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_landed", F.lit(0)).alias("n_landed"))
    status = (F.when(F.col("n_landed") == 0, F.lit("missing"))
               .when(F.col("n_source") == 0, F.lit("extra"))
               .when(F.col("n_landed") > F.col("n_source"), F.lit("duplicated"))
               .otherwise(F.lit("matched")))
    return j.withColumn("status", status)
