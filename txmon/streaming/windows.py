"""Event-time operators (T6-T10); each also runs on a batch DataFrame unchanged.

Event time must be TIMESTAMP (not TIMESTAMP_NTZ) for a watermark, so it is cast first.
In append mode a window / session is emitted once the watermark passes its end, so a bounded run
never emits the last ones. ``land_windows`` therefore runs windows in update mode and lands every
change; ``read_windows`` keeps the latest state of each window. The watermark (max event time seen -
delay) bounds the state kept, and rows older than it are dropped (T10, counted by
``monitor.dropped_by_watermark``). Sessions (T8) are in ``streaming.sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.session import ensure_folder
from txmon.sources.compaction import compact_batches, latest, read_batches
from txmon.sources.sinks import batch_writer
from txmon.streaming.keyed import interval_micros


def event_time(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return d.withWatermark(ts, watermark) if watermark else d


def windowed(df: DataFrame, ts: str, duration: str, by=(), value: str | None = None,
             slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """T6 (tumbling) / T7 (sliding when ``slide``): count and total per window and key."""
    d = event_time(df, ts, watermark)
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    g = d.groupBy(w.alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *by, *[a for a in ["n", "total"] if a in g.columns])


def land_windows(windows: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Land every change of streaming windows, one folder per micro-batch (a replayed batch replaces its own)."""
    w = windows.writeStream.outputMode("update").foreachBatch(batch_writer(target)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_windows(spark: SparkSession, target: str, keys: list[str], compacted: str | None = None) -> DataFrame:
    """The latest landed state of every window: rows of one key are reduced before the shuffle. ``compacted`` names the
    folder that ``compact_windows`` keeps."""
    d = read_batches(spark, target, compacted) if compacted else spark.read.parquet(target)
    return latest(keys)(d).drop("batch_id")


def compact_windows(spark: SparkSession, target: str, keys: list[str], compacted: str) -> int:
    """Pack the landed micro-batches, without the newest, into few files that hold the latest state of each window."""
    return compact_batches(spark, target, compacted, latest(keys))


def land_windows_and_late(df: DataFrame, ts: str, duration: str, by, target: str, late: str, checkpoint: str, value: str | None = None,
                          slide: str | None = None, delay: str = "1 hour", trigger: dict | None = None):
    """Windows of the rows that come in time, and every row that comes too late in a side table.

    The watermark of a micro-batch is the newest event time of all earlier ones less ``delay``; a row is late when its last window
    has ended by then. Each batch lands three folders ``batch_id=N`` (a replayed batch replaces its own, with the same
    watermark): its late rows whole under ``late/rows``, its part of each window under ``target``, and the newest event time under
    ``late/marks``. Windows are sums of parts, so no state is kept and a window's part counts even when others have closed it.
    Rows without an event time are late. ``read_window_parts`` adds the parts up; landed rows and late rows are all rows.
    """
    spark = df.sparkSession
    keys = [by] if isinstance(by, str) else list(by)
    marks, rows, parts = f"{late}/marks", batch_writer(f"{late}/rows"), batch_writer(target)
    ensure_folder(spark, marks)
    ensure_folder(spark, f"{late}/rows")
    ensure_folder(spark, target)

    def land(batch: DataFrame, batch_id: int) -> None:
        d = event_time(batch, ts, None).persist()
        try:
            seen = spark.read.schema("newest timestamp, batch_id long").parquet(marks).filter(F.col("batch_id") < batch_id)
            mark = seen.select(F.max("newest") - F.expr(f"INTERVAL {delay}")).first()[0]
            w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
            step = interval_micros(slide or duration)  # the last window of a row begins at the last step at or before it
            begins = F.unix_micros(ts) - F.pmod(F.unix_micros(ts), step)
            in_time = F.col(ts).isNotNull()
            if mark is not None:
                in_time = in_time & (F.timestamp_micros(begins + interval_micros(duration)) > F.lit(mark))
            rows(d.filter(~F.coalesce(in_time, F.lit(False))), batch_id)
            sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
            g = d.filter(in_time).groupBy(w.alias("w"), *keys).agg(*sums)
            parts(g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[c for c in ("n", "total") if c in g.columns]), batch_id)
            batch_writer(marks)(d.agg(F.max(ts).alias("newest")), batch_id)
        finally:
            d.unpersist()

    return df.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_window_parts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Windows from the parts that ``land_windows_and_late`` landed."""
    d = spark.read.parquet(target)
    sums = [F.sum(c).cast(d.schema[c].dataType).alias(c) for c in ("n", "total") if c in d.columns]
    return d.groupBy(*keys).agg(*sums)


def dedup_stream(df: DataFrame, id_col: str, ts: str, delay: str) -> DataFrame:
    """Drop re-delivered copies of an id seen within ``delay`` of event time (state per id is
    dropped once the watermark passes it)."""
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark([id_col])
