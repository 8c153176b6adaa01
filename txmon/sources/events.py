"""Event messages: stream source (S1) and JSON decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.schemas import RAW_SCHEMA

CORRUPT = "_corrupt_record"  # from_json's working column
DECODE_ERROR = "decode_error"  # output name: the raw text of a message that failed to decode
NO_BODY = "(no message body)"


def read_event_stream(spark: SparkSession, source: str = "kafka", convert=None, **opts) -> DataFrame:
    """Streaming DataFrame of bus messages with columns ``key, value, timestamp``.

    ``source="kafka"`` reads all partitions from the earliest offset (resume position is kept
    by the query's checkpoint). Any other file format (``parquet``, ``json``...) is read
    from ``opts["path"]`` and ``convert`` (if given) turns its rows into messages, e.g.
    ``fixtures.events_to_messages`` for a folder of ``events`` rows.
    """
    if source == "kafka":
        reader = spark.readStream.format("kafka").option("startingOffsets", "earliest")
        for k, v in opts.items():
            reader = reader.option(k, v)
        return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"),
                                    "timestamp")
    path = opts.pop("path")
    schema = opts.pop("schema", None)
    reader = spark.readStream.format(source)
    if schema is not None:
        reader = reader.schema(schema)
    for k, v in opts.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    return convert(df) if convert is not None else df


def decode_events(df: DataFrame, value_col: str = "value", mode: str = "quarantine",
                  ingest_col: str | None = "timestamp") -> DataFrame:
    """Decode UTF-8 JSON message bodies into the raw event columns.

    A message must be one JSON object, and nothing else, with a ``transaction_id``: an absent body, text before or
    after the object, NaN or Infinity, a field of the wrong type and an object without id do not decode. The body
    is parsed once, inside an envelope that closes with a checksum of it, so that what follows the object cannot be overlooked
    (a parser alone stops at the object's end).

    mode ``quarantine`` keeps every message and adds ``decode_error`` (the original text of a message that does not
    decode, ``NO_BODY`` where there is no text, else NULL; a neutral name, because file readers treat a column
    called ``_corrupt_record`` as their own). A message whose only fault is a field of the wrong type keeps its other fields.
    ``drop`` keeps decoded rows only; ``failfast`` raises on the first bad message, as the original consumer does.
    The source ingest time (``ingest_col``) is kept as ``ingest_time``.
    """
    body = F.col(value_col).cast("string")
    check = F.xxhash64(body)
    envelope = T.StructType([T.StructField("message", RAW_SCHEMA), T.StructField("check", T.LongType()), T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.concat(F.lit('{"message":'), body, F.lit(',"check":'), check.cast("string"), F.lit("}")), envelope,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"})
    message = parsed["message"]
    decoded = F.coalesce(parsed[CORRUPT].isNull() & (parsed["check"] == check) & message["transaction_id"].isNotNull(), F.lit(False))
    corrupt = F.when(~decoded, F.when(F.trim(body) != "", body).otherwise(F.lit(NO_BODY)))
    if mode == "failfast":
        message = F.when(~decoded, F.raise_error(F.concat(F.lit("message does not decode: "), corrupt))).otherwise(message)
    extra = [F.col(ingest_col).cast("timestamp").alias("ingest_time")] if ingest_col and ingest_col in df.columns else []
    out = df.select(message.alias("_m"), corrupt.alias(CORRUPT), *extra)
    out = out.select(*[F.col("_m")[f.name].alias(f.name) for f in RAW_SCHEMA.fields],
                     F.col(CORRUPT).alias(DECODE_ERROR), *[c for c in ("ingest_time",) if extra])
    if mode == "drop":
        out = out.filter(F.col(DECODE_ERROR).isNull()).drop(DECODE_ERROR)
    elif mode == "failfast":
        out = out.drop(DECODE_ERROR)
    return out
