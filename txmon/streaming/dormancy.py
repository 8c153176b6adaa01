"""T4: dormant-account detection on a stream with per-account state.

State per account is one time (the last transaction seen), in RocksDB and checkpointed with the query. An account's time
is cut into segments no longer than the shortest gap that counts, so within a segment only the first row, by
(ts, id), can end a dormant gap: map tasks reduce their rows to (first row, last time) per account and
segment before the shuffle (``keyed``), and the state step sees one short row per segment however hot an account
is. Results equal the batch ``lag`` plan (F6) whenever micro-batches arrive in event-time order; rows older than the stored last
time are late: they are not flagged and do not move the state back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from txmon.streaming.keyed import before_state, prepare, segment_of

#: Longest segment, in microseconds; shorter if the gap is.
HOUR = 3_600_000_000

FLAGGED = "account string, id string, ts long, prev_ts long, amount double"
FLAGGED_ROW = Row("account", "id", "ts", "prev_ts", "amount")


def first_and_last(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per (account, segment): its first row by (ts, id), NULL ids last, and its last time."""
    rows = rows.sort_values(["account", "segment", "ts", "id"], na_position="last", kind="stable")
    rows["last_ts"] = rows.groupby(["account", "segment"], dropna=False, sort=False)["last_ts"].transform("max")
    return rows.drop_duplicates(["account", "segment"])


class Dormancy(StatefulProcessor):
    """Flags first rows of segments whose previous transaction, in the batch or in the state, is long past. An account has
    few segments in a batch, so they are compared as plain tuples. (Takes frames; ``RowDormancy`` takes rows.)"""

    def __init__(self, min_gap: int, min_amount: float, keep: int | None):
        self.min_gap, self.min_amount, self.keep = min_gap, min_amount, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["account", "segment", "id", "ts", "amount", "last_ts"]
        hits = self._hits(key, (row for chunk in rows for row in chunk[columns].itertuples(index=False, name=None)))
        if hits:
            yield pd.DataFrame(hits, columns=["account", "id", "ts", "prev_ts", "amount"])

    def _hits(self, key, rows: Iterable[tuple]) -> list[tuple]:
        segments: dict[int, tuple] = {}  # a segment's first row by (ts, id), missing ids last, and its last time
        for _, segment, id_, ts, amount, last_ts, *_ in rows:
            row, seen = ((ts, id_ is None, id_ or ""), id_, ts, amount, last_ts), segments.get(segment)
            if seen is None or row[0] < seen[0]:
                segments[segment] = (*row[:4], last_ts if seen is None else max(last_ts, seen[4]))
            elif last_ts > seen[4]:
                segments[segment] = (*seen[:4], last_ts)
        if not segments:
            return []
        stored = self.last.get()
        known = before = None if stored is None else stored[0]
        hits = []
        for _, (_, id_, ts, amount, last_ts) in sorted(segments.items()):
            # a segment that begins at or before the known time cannot end a gap
            fresh = before is not None and (known is None or ts > known)
            if fresh and ts - before >= self.min_gap and amount is not None and amount >= self.min_amount:
                hits.append((key[0], id_, ts, before, amount))
            before = last_ts if before is None else max(before, last_ts)
        if before != known:
            self.last.update((before,))
            if known is None and self.keep is not None:
                self._remind(before)
        return hits

    def _remind(self, last_ts: int) -> None:
        """One timer per account, at or before the end of what it keeps; it sets the next one if the account has moved on."""
        self.handle.registerTimer((last_ts + self.keep) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        known = self.last.get()
        if known is not None:
            if (known[0] + self.keep) // 1000 <= timerValues.getCurrentWatermarkInMs():
                self.last.clear()
            else:
                self._remind(known[0])
        return iter(())

    def close(self) -> None:
        pass


class RowDormancy(Dormancy):
    """The same on rows: no frame is built for an account."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for hit in self._hits(key, (tuple(row) for row in rows)):
            yield FLAGGED_ROW(*hit)


def account_segments(df: DataFrame, account: str, ts: str, amount: str, id_col: str, min_gap_seconds: float) -> DataFrame:
    """The rows that reach the state step: per account and segment one (first row, last time) from each map task."""
    length = max(1, min(HOUR, int(min_gap_seconds * 1e6)))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(F.col(account).cast("string").alias("account"), segment_of(at, length).alias("segment"),
                     F.col(id_col).cast("string").alias("id"), at.alias("ts"), F.col(amount).cast("double").alias("amount"),
                     at.alias("last_ts")).filter("ts IS NOT NULL")
    return before_state(rows, first_and_last)


def dormant_stream(df: DataFrame, account: str, ts: str, amount: str, id_col: str, min_gap_seconds: float, min_amount: float,
                   keep_seconds: float | None = None, watermark: str = "1 hour") -> DataFrame:
    """Flagged rows (account, id, ts, prev_ts, gap_seconds, amount) of a streaming DataFrame.

    ``keep_seconds`` bounds the state: an account's time is dropped by an event-time timer once the watermark (``watermark`` behind the
    newest row) is that far past it, and its next transaction counts as its first. It must cover every gap that should be flagged;
    None keeps all accounts. Rows without a time are left out, a missing account is an account of its own."""
    prepare(df.sparkSession)
    segments = account_segments(df, account, ts, amount, id_col, min_gap_seconds)
    keep = None
    if keep_seconds is not None:
        keep = int(keep_seconds * 1e6)
        segments = segments.withColumn("at", F.timestamp_micros("last_ts")).withWatermark("at", watermark)
    step = RowDormancy(int(min_gap_seconds * 1e6), float(min_amount), keep)
    flagged = segments.groupBy("account").transformWithState(step, FLAGGED, "Append", "None" if keep is None else "EventTime")
    return flagged.select("account", "id", F.timestamp_micros("ts").alias("ts"), F.timestamp_micros("prev_ts").alias("prev_ts"),
                          ((F.col("ts") - F.col("prev_ts")) / F.lit(1e6)).alias("gap_seconds"), "amount")
