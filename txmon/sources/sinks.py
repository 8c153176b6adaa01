"""Sinks: date-partitioned routed files (S3), stream-to-table (S6), flat-table loads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.operators.reconcile import dedup_earliest
from txmon.operators.rules import RuleConfig, flag_reasons, route
from txmon.sources.keyindex import candidate_periods, index_of, read_index

PARTITIONS = ["route", "year", "month", "day"]


def to_text_columns(df: DataFrame) -> DataFrame:
    """Nested columns -> JSON text, arrays -> JSON text (CSV holds flat text only)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def with_route_partitions(df: DataFrame, cfg: RuleConfig = RuleConfig(), partition_by: str = "processing",
                          event_ts: str = "timestamp", processing_ts: str = "ingest_time") -> DataFrame:
    """Add ``route``, ``flag_reasons`` and zero-padded ``year/month/day`` (UTC) of the
    processing time (as the reference folders do) or of the event time."""
    if partition_by == "processing" and processing_ts in df.columns:
        src = F.col(processing_ts)
    elif isinstance(df.schema[event_ts].dataType, T.StringType):
        src = F.try_to_timestamp(F.col(event_ts))
    else:
        src = F.col(event_ts).cast("timestamp")
    d = flag_reasons(route(df, cfg), cfg)
    return d.withColumns({"year": F.date_format(src, "yyyy"), "month": F.date_format(src, "MM"),
                          "day": F.date_format(src, "dd")})


def write_routed(df: DataFrame, base: str, cfg: RuleConfig = RuleConfig(), fmt: str = "csv",
                 partition_by: str = "processing", mode: str = "append", event_ts: str = "timestamp",
                 processing_ts: str = "ingest_time", folders: list[str] = PARTITIONS) -> None:
    """S3 (batch): one pass writes both routes, partitioned by route and date; appends new files
    with unique names (no overwrite of earlier flushes). ``folders`` may leave out ``day`` (or ``month`` and ``day``) where
    a day holds few rows: it is then a column of the files, and ``read_routed`` takes it from there."""
    d = with_route_partitions(df, cfg, partition_by, event_ts, processing_ts)
    d = to_text_columns(d.drop(processing_ts) if processing_ts in d.columns else d)
    # cluster rows by output folder before writing: AQE coalesces small (route, day) groups and
    # splits a hot one, so each folder gets a few right-sized files instead of one per task
    d = d.hint("rebalance", *folders)
    w = d.write.mode(mode).partitionBy(*folders).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    w.save(base)


def load_flat(df: DataFrame, path: str, mode: str = "incremental", key: str = "transaction_id",
              order: str = "processing_time", fmt: str = "parquet") -> None:
    """Load flattened rows into the flat table at ``path``.

    ``append``      inserts every row on every call (the reference procedure's behaviour).
    ``incremental`` inserts each key once: the earliest row (``order``) of the keys that are not in
                    the table yet (left anti join on the projected key column). Rows without a key
                    cannot be told apart and are left out; V1 reports them. Only a missing table
                    counts as a first load; any other read error is raised.
    """
    spark = df.sparkSession
    if mode == "incremental":
        ties = [c for c in df.columns if c not in (key, order)]
        df = dedup_earliest(df.filter(F.col(key).isNotNull()), key, order, ties).drop("n_copies").select(*df.columns)
        existing = _existing(spark, path, fmt)
        if existing is not None:
            df = df.join(existing.select(key), key, "left_anti")
    elif mode != "append":
        raise ValueError("mode must be 'append' or 'incremental'")
    df.write.mode("append").format(fmt).save(path)


def _existing(spark, path: str, fmt: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The table at ``path``; None where there is none yet. Any other read error is raised."""
    reader = spark.read.format(fmt)
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def load_by_period(df: DataFrame, path: str, key: str = "transaction_id", order: str = "processing_time",
                   time: str | None = None, period: str = "yyyy-MM-dd", fmt: str = "parquet") -> dict:
    """S8 / J2 for a large table: as ``load_flat(mode="incremental")``, but the table at ``path`` has a folder
    ``load_period=...`` per day (or other ``period``) of ``time`` (default: ``order``; no time: ``none``), and a load reads the keys of only
    those folders that may hold one of its keys: ``path + "_keys"`` stores Bloom filters of each folder's keys (``keyindex``), so a key
    that comes back under another date is found as well. Exact: the filters only choose which folders are compared.

    The index is written before the rows: a load that fails in between leaves names of keys that are not there, which
    costs a later comparison and nothing else. One load at a time. Returns how many folders the table had and how many were read.
    """
    spark = df.sparkSession
    ties = [c for c in df.columns if c not in (key, order)]
    of_period = F.coalesce(F.date_format(F.col(time or order).cast("timestamp"), period), F.lit("none"))
    new = (dedup_earliest(df.filter(F.col(key).isNotNull()), key, order, ties).drop("n_copies").select(*df.columns)
           .withColumn("load_period", of_period).persist())
    try:
        index = read_index(spark, f"{path}_keys")
        keys = new.select(F.col(key).cast("string").alias("key"))
        stored = index.select("period").distinct().count()
        asked = candidate_periods(keys, index)
        fresh = new
        columns = T.StructType([new.schema[key], new.schema["load_period"]])  # a folder's name is text, whatever it looks like
        if asked and (table := _existing(spark, path, fmt, columns)) is not None:
            old = table.filter(F.col("load_period").isin(asked)).select(key)
            fresh = new.join(old, key, "left_anti").select(*new.columns).persist()
        index_of(fresh.select(F.col("load_period").alias("period"), F.col(key).cast("string").alias("key"))).write.mode("append").parquet(f"{path}_keys")
        fresh.hint("rebalance", "load_period").write.mode("append").partitionBy("load_period").format(fmt).save(path)
        if fresh is not new:
            fresh.unpersist()
    finally:
        new.unpersist()
    return {"stored": stored, "read": len(asked)}


def batch_writer(target: str, fmt: str = "parquet", partition_by=()):
    """A ``foreachBatch`` function that writes each micro-batch to ``target/batch_id=N``
    with overwrite, so a replayed batch id replaces its own output (idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(f"{target.rstrip('/')}/batch_id={batch_id}")
    return write


def sink_stream(df: DataFrame, target: str, checkpoint: str, trigger: dict | None = None,
                fmt: str = "parquet"):
    """Continuous insert of a streaming projection into a table folder."""
    q = df.writeStream.foreachBatch(batch_writer(target, fmt)).option("checkpointLocation", checkpoint)
    q = q.trigger(**(trigger or {"availableNow": True}))
    return q.start()
