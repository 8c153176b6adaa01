"""Activity sessions per key; a session ends ``gap`` after its last event.

A key's time is cut into segments no longer than the gap. Two events of one segment are then always of one session, so a segment
is known by its first and last time, count and total: these are ordinary aggregates, combined in the map
tasks, and no task ever sorts a key's events. Sessions are chains of segments.

* ``sessions``: a finished input. Segments are chained by the skew-safe helpers (previous value, running sum).
* ``land_sessions`` / ``read_sessions``: a stream. The state holds each key's open sessions, every change of a session
  lands at once, and an event-time timer closes it when the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from txmon.operators.segmented import previous_value, running_sum
from txmon.sources.sinks import batch_writer
from txmon.streaming.keyed import before_state, interval_micros, prepare, segment_of

#: Working columns of a segment or session: times in microseconds, events, total. (The state step gets rows as named
#: tuples, whose names may not begin with an underscore; a key travels as one text, so a missing key is a key.)
FIRST, LAST, N, TOTAL = "first", "last", "n", "total"
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _output(df: DataFrame, keys: list, gap: str, value: str | None, extra=()) -> DataFrame:
    return df.select(F.timestamp_micros(FIRST).alias("session_start"), F.timestamp_micros(F.col(LAST) + interval_micros(gap)).alias("session_end"),
                     *keys, F.col(N).alias("n"), F.timestamp_micros(FIRST).alias("first_ts"), F.timestamp_micros(LAST).alias("last_ts"),
                     *([F.col(TOTAL).alias("total")] if value else []), *extra)


def sessions(df: DataFrame, ts: str, gap: str, by, value: str | None = None) -> DataFrame:
    """Sessions of a finished input: session_start, session_end, keys, n, first_ts, last_ts and, with ``value``, its total.
    Events without a time are left out; a missing key is a key of its own."""
    keys = [f"_key{i}" for i, _ in enumerate(_keys(by))]
    named = [F.col(k).alias(name) for k, name in zip(keys, _keys(by))]
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(*[F.col(name).alias(k) for k, name in zip(keys, _keys(by))], at.alias("_at"),
                     *([F.col(value).alias(TOTAL)] if value else [])).filter("_at IS NOT NULL")
    sums = [F.min("_at").alias(FIRST), F.max("_at").alias(LAST), F.count(F.lit(1)).alias(N)]
    if value:
        sums.append(F.sum(TOTAL).alias(TOTAL))
    segments = rows.groupBy(*keys, segment_of(F.col("_at"), interval_micros(gap)).alias("_segment")).agg(*sums)
    chained = previous_value(segments, keys, [FIRST], LAST, "_before")
    begins = F.col("_before").isNull() | (F.col(FIRST) - F.col("_before") >= interval_micros(gap))
    numbered = running_sum(chained.withColumn("_new", begins.cast("long")), keys, [FIRST], "_new", "_session")
    ends = [F.min(FIRST).alias(FIRST), F.max(LAST).alias(LAST), F.sum(N).alias(N)]
    if value:
        ends.append(F.sum(TOTAL).cast(segments.schema[TOTAL].dataType).alias(TOTAL))
    return _output(numbered.groupBy(*keys, "_session").agg(*ends), named, gap, value)


#: Rows of the state step's output.
CHANGE = Row("key", FIRST, LAST, N, TOTAL, "closed")


class Sessions(StatefulProcessor):
    """Open sessions of a key; changes leave as rows, a session that another one has absorbed as a row with no events.

    A key has few rows in a batch, so they are taken as plain tuples, and it has a timer at or before the end of its earliest
    open session only: the timer closes what is over and sets the next one."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total double")

    def _keep(self, sessions: list[tuple], due: int | None = None) -> None:
        """Store the open sessions; ``due``: an end for which a timer stands already."""
        self.open.put(sessions) if sessions else self.open.clear()
        ends = min((s[1] for s in sessions), default=None)
        if ends is not None and (due is None or ends < due):
            self.handle.registerTimer((ends + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = [tuple(s) for s in self.open.get()]
        chained: list[tuple] = []
        for first, last, n, total in sorted([*known, *(tuple(r)[1:5] for r in rows)]):
            if chained and first - chained[-1][1] < self.gap:
                f, l, m, t = chained[-1]
                chained[-1] = (f, max(l, last), m + n, t + total)
            else:
                chained.append((first, last, n, total))
        before, starts = set(known), {s[0] for s in chained}
        kept = [s for s in chained if s[1] + self.gap > now]
        self._keep(kept, min((s[1] for s in known), default=None))
        for s in chained:
            over = s[1] + self.gap <= now  # the watermark has passed it already
            if over or s not in before:
                yield CHANGE(key[0], *s, over)
        for f, l, _, _ in known:
            if f not in starts:
                yield CHANGE(key[0], f, l, 0, 0.0, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = [tuple(s) for s in self.open.get()]
        if known:
            self._keep([s for s in known if s[1] + self.gap > now])
        for s in known:
            if s[1] + self.gap <= now:
                yield CHANGE(key[0], *s, True)

    def close(self) -> None:
        pass


def segments_of(df: DataFrame, ts: str, gap: str, keys: list[str], value: str | None = None) -> DataFrame:
    """The rows that reach the state step: per key and segment one from each map task."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.to_json(F.struct(*keys), KEY_TEXT).alias("key"), segment_of(at, interval_micros(gap)).alias("segment"), at.alias(FIRST), at.alias(LAST),
                     F.lit(1).cast("long").alias(N), (F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)).alias(TOTAL))

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        whole = part.groupby(["key", "segment"], sort=False, as_index=False).agg(
            **{FIRST: (FIRST, "min"), LAST: (LAST, "max"), N: (N, "sum"), TOTAL: (TOTAL, "sum")})
        return whole[list(part.columns)]

    return before_state(rows.filter(F.col(FIRST).isNotNull()), reduce)


def land_sessions(df: DataFrame, ts: str, gap: str, by, target: str, checkpoint: str, value: str | None = None,
                  watermark: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Land every change of a stream's sessions, one folder per micro-batch (a replayed batch replaces its own).

    Events older than the watermark are dropped, unless they share their segment with one that is not. ``total`` sums in double precision."""
    spark = df.sparkSession
    prepare(spark)
    keys = _keys(by)
    step_gap = spark.range(1).select(interval_micros(gap)).first()[0]
    rows = segments_of(df, ts, gap, keys, value).select("key", FIRST, LAST, N, TOTAL, F.timestamp_micros(LAST).alias("at")).withWatermark("at", watermark)
    shape = f"key string, {FIRST} long, {LAST} long, {N} long, {TOTAL} double, closed boolean"
    changes = rows.groupBy("key").transformWithState(Sessions(step_gap), shape, "Update", "EventTime")
    key = F.from_json("key", T.StructType([df.schema[k] for k in keys]), KEY_TEXT)
    out = _output(changes.withColumn("key", key), [F.col("key")[k].alias(k) for k in keys], gap, value, ["closed"])
    w = out.writeStream.outputMode("update").foreachBatch(batch_writer(target)).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_sessions(spark: SparkSession, target: str, by) -> DataFrame:
    """The latest landed state of every session, open ones included; ``closed`` says that the watermark has passed its end."""
    d = spark.read.parquet(target)
    keys = [*_keys(by), "session_start"]
    values = [c for c in d.columns if c not in (*keys, "batch_id")]
    order = F.struct(F.col("batch_id").cast("long"), "closed")
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.filter("_last.n > 0").select("session_start", "_last.session_end", *_keys(by), *[f"_last.{c}" for c in values if c != "session_end"])
