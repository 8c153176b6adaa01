"""Continuous classify-and-route (T1-T3) and the suspicious-file alert stream (T5).

Routing uses Spark's file sink, which commits each micro-batch through its metadata log: a batch is
visible exactly once even when a task or executor is lost and the batch is re-run. Alerts land in one folder
per micro-batch, which a re-run replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txmon.operators.alerts import alert_messages, error_message
from txmon.operators.rules import RuleConfig
from txmon.sources.events import decode_events
from txmon.sources.files import ROUTED_COLUMNS, by_header, file_heads, read_file_rows
from txmon.sources.sinks import PARTITIONS, batch_writer, to_text_columns, with_route_partitions


def _trigger(writer, trigger: dict | None):
    return writer.trigger(**(trigger or {"availableNow": True}))


def monitor_stream(messages: DataFrame, base: str, checkpoint: str, cfg: RuleConfig = RuleConfig(),
                   trigger: dict | None = None, partition_by: str = "processing",
                   fmt: str = "csv") -> StreamingQuery:
    """Bus messages -> decode (S2) -> flag + reasons (F3/F4) -> route (F5) -> one file sink
    partitioned by ``route/year/month/day`` (S3). Messages that do not decode (malformed JSON, or a
    field of the wrong type) land in the ``quarantine`` route with their text in ``decode_error``.

    T2: micro-batch size comes from the source (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger``)
    and ``trigger`` (e.g. ``{"processingTime": "1 minute"}``); T3: the default trigger is
    ``availableNow`` -- process what is there, then stop (a bounded scheduled run)."""
    decoded = decode_events(messages)
    routed = to_text_columns(with_route_partitions(decoded, cfg, partition_by)).select(*ROUTED_COLUMNS, *PARTITIONS)
    w = (routed.writeStream.format(fmt).outputMode("append").partitionBy(*PARTITIONS)
               .option("path", base).option("checkpointLocation", checkpoint))
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    return _trigger(w, trigger).start()


def run_available(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` run to finish (raises if the query failed). A run over its
    time bound is stopped; the next run resumes from the checkpoint."""
    done = query.awaitTermination(timeout_s)
    if timeout_s is not None and not done:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query


def alert_rows(rows: DataFrame, bad_files: DataFrame) -> DataFrame:
    """T5: alerts of suspicious rows, error alerts of quarantined rows, and one error alert for each unreadable file."""
    is_error = F.col("route") == "quarantine"
    alerts = alert_messages(rows).withColumn("message", F.when(is_error, error_message()).otherwise(F.col("message")))
    errors = bad_files.select("source_file", F.lit("file_error").alias("route"), F.col("error").alias("decode_error")).withColumn("message", error_message())
    columns = ["transaction_id", "route", "source_file", "amount", "fee", "sender_name", "receiver_name", "message", "decode_error"]
    return alerts.select(*columns).unionByName(errors, allowMissingColumns=True).select(*columns)


def alert_stream(spark: SparkSession, routed_base: str, target: str, checkpoint: str,
                 trigger: dict | None = None, layout: str = "hive", **read_opts) -> StreamingQuery:
    """T5: stream new suspicious files into an alert table (parquet, a folder ``batch_id=N`` for each micro-batch; a
    replayed batch replaces its own).

    ``layout="hive"`` reads the routed sink's suspicious and quarantined rows through its commit log, so each
    row alerts once; ``layout="plain"`` reads ``base/YYYY/MM/DD/*.csv`` from whatever wrote them. Suspicious rows give the alert
    text, quarantined rows an error alert with the message's own text. A file that cannot be read gives one error
    alert, and all other files of the batch alert as usual (``files.by_header``)."""
    rows = read_file_rows(spark, routed_base, streaming=True, layout=layout, **read_opts).filter(F.col("route").isin("suspicious", "quarantine"))
    write = batch_writer(target)

    def land(batch: DataFrame, batch_id: int) -> None:
        heads = file_heads(batch).persist()  # one row per file; the rows themselves are read again, not kept
        try:
            write(alert_rows(*by_header(batch, files=heads)), batch_id)
        finally:
            heads.unpersist()

    return _trigger(rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint), trigger).start()


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows dropped as too late by the query's stateful operators, over its progress history."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else getattr(p, "stateOperators", []):
            total += int(op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else op.numRowsDroppedByWatermark)
    return total
