"""Keyed streams: hot keys are reduced before the state, state expires, sessions merge, close and survive restarts."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from txmon.operators.rules import flag_dormant
from txmon.session import scratch_path
from txmon.streaming import dormancy as dm
from txmon.streaming import keyed
from txmon.streaming import monitor as pl
from txmon.streaming import sessions as ss

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "account string, id string, ts timestamp, amount double"


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def stream(spark, slices, schema=SCHEMA, path=None):
    """A stream that reads each list of rows as one micro-batch."""
    path = path or scratch_path(spark, "slices")
    for rows in slices:
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(flagged, spark, ck=None):
    out = scratch_path(spark, "out")
    pl.run_available(flagged.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck or scratch_path(spark, "ck")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def hot_rows(n=6000):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else f"a{rng.randrange(40)}", f"{i:05}", at(rng.choice([rng.random() * 5, 50 + rng.random() * 9, 90])), rng.choice([10.0, 500.0])) for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


def test_a_hot_account_reaches_the_state_as_a_few_segments(spark):
    rows = spark.createDataFrame(hot_rows(), SCHEMA).repartition(6)
    sizes = {r.task: r["count"] for r in rows.filter("account = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()}
    assert len(sizes) == 6 and max(sizes.values()) < 2 * 2000 / 6  # every map task reduces its part of the hot account
    reduced = dm.account_segments(rows, "account", "ts", "amount", "id", 86400.0)
    per_task = reduced.filter("account = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert all(r["count"] <= 16 for r in per_task)  # 15 hours and one instant, however many rows
    n = reduced.filter("account = 'hot'").count()
    assert n <= 6 * 16 and rows.filter("account = 'hot'").count() == 2000


@pytest.mark.parametrize("gap", [3600.0, 86400.0, 0.5])
def test_dormancy_equals_the_batch_plan(spark, gap):
    rows = [*hot_rows(1500), (None, "n1", at(0), 500.0), (None, "n2", at(60), 500.0), ("nulls", None, at(1), 500.0), ("nulls", "x", at(70), 500.0), ("nulls", "y", None, 1e9)]
    slices = [[r for r in rows if r[2] is None or lo <= r[2] < hi] if lo == DAY else [r for r in rows if r[2] is not None and lo <= r[2] < hi]
              for lo, hi in ((DAY, at(4)), (at(4), at(55)), (at(55), at(1000)))]
    got = run(dm.dormant_stream(stream(spark, slices), "account", "ts", "amount", "id", gap, 100.0), spark)
    batch = flag_dormant(spark.createDataFrame([r for r in rows if r[2] is not None], SCHEMA), "account", "ts", "amount", "id", gap, 100.0).filter("is_dormant_burst")
    key = ["account", "id", "ts", "prev_ts", "gap_seconds", "amount"]
    want = sorted((tuple(r) for r in batch.select(*key).collect()), key=repr)
    assert sorted((tuple(r) for r in got.select(*key).collect()), key=repr) == want and len(want) > 10
    assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB


def test_late_rows_neither_flag_nor_move_the_state_back(spark):
    slices = [[("a", "1", at(100), 1.0)], [("a", "2", at(10), 900.0), ("a", "3", at(101), 900.0)], [("a", "4", at(130), 900.0)]]
    got = run(dm.dormant_stream(stream(spark, slices), "account", "ts", "amount", "id", 20 * 3600.0, 100.0), spark).collect()
    assert [(r.id, r.prev_ts) for r in got] == [("4", at(101))]


@pytest.mark.parametrize("keep_hours,flagged", [(None, ["back"]), (1000, ["back"]), (200, [])])
def test_old_state_expires(spark, keep_hours, flagged):
    slices = [[("a", "first", at(0), 1.0), ("b", "b0", at(0), 1.0)], [("b", f"b{k}", at(250 + k), 1.0) for k in range(1, 4)],
              [("b", "b4", at(300), 1.0)], [("a", "back", at(400), 900.0)]]
    keep = None if keep_hours is None else keep_hours * 3600.0
    got = run(dm.dormant_stream(stream(spark, slices), "account", "ts", "amount", "id", 24 * 3600.0, 100.0, keep_seconds=keep), spark).collect()
    assert [r.id for r in got] == flagged


# --- sessions -----------------------------------------------------------------------------------

def brute(rows, gap_hours):
    out, by = [], {}
    for key, ts, v in rows:
        if ts is not None:
            by.setdefault(key, []).append((ts, v or 0.0))
    for key, events in by.items():
        events.sort()
        for ts, v in events:
            if out and out[-1][0] == key and ts - out[-1][2] < dt.timedelta(hours=gap_hours):
                k, first, _, n, total = out[-1]
                out[-1] = (k, first, ts, n + 1, total + v)
            else:
                out.append((key, ts, ts, 1, v))
    return sorted(out, key=repr)


def found(df, key="k"):
    rows = df.collect()
    assert all(r.session_start == r.first_ts and r.session_end > r.last_ts for r in rows)
    return sorted(((r[key], r.first_ts, r.last_ts, r.n, r.total) for r in rows), key=repr)


EVENTS = "k string, ts timestamp, v double"


def event_rows(seed, n=1500):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "a", "b", None]), at(rng.choice([rng.random() * 300, rng.randrange(300)])), float(rng.randrange(9))) for _ in range(n)] + [("a", None, 1.0)]


@pytest.mark.parametrize("gap", ["1 hour", "30 minutes", "7 hours"])
def test_batch_sessions_of_a_hot_key(spark, gap):
    hours = {"1 hour": 1, "30 minutes": 0.5, "7 hours": 7}[gap]
    rows = event_rows(2) + [("edge", at(h), 1.0) for h in (-100, -99.5, -98.5, 0, hours, 2 * hours, 3 * hours - 0.001)]
    assert found(ss.sessions(spark.createDataFrame(rows, EVENTS), "ts", gap, "k", "v")) == brute(rows, hours)
    empty = ss.sessions(spark.createDataFrame([], EVENTS), "ts", gap, "k", "v")
    assert empty.count() == 0


def test_raw_events_of_a_key_are_never_windowed(spark):
    plan = ss.sessions(spark.createDataFrame(event_rows(1, 20), EVENTS), "ts", "1 hour", "k")._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.rindex("Window"):]
    assert "HashAggregate" in below  # every window stands above the aggregate per (key, segment)


def test_stream_sessions_merge_and_keep_the_open_ones(spark):
    rows = sorted((r for r in event_rows(3, 900) if r[1] is not None), key=lambda r: r[1])
    slices = [rows[:300], rows[300:500], rows[500:]]
    # within the watermark a later batch may join two sessions, or begin one earlier
    slices[1] = slices[1] + [("late", at(80), 1.0), ("late", at(82.2), 2.0)]
    slices[2] = slices[2] + [("late", at(81.1), 4.0), ("late", at(79.2), 8.0)]
    src, out, ck = scratch_path(spark, "src"), scratch_path(spark, "out"), scratch_path(spark, "ck")
    for part in slices:  # a restart between batches
        s = stream(spark, [part], EVENTS, src)
        pl.run_available(ss.land_sessions(s, "ts", "90 minutes", "k", out, ck, value="v", watermark="300 hours"))
    got = ss.read_sessions(spark, out, "k")
    assert found(got) == brute([r for part in slices for r in part], 1.5)
    assert {r.closed for r in got.collect()} == {False}


def test_timers_close_sessions_behind_the_watermark(spark):
    rows = [("a", at(0), 1.0), ("a", at(0.5), 1.0), ("b", at(3), 1.0)]
    slices = [rows, [("b", at(9), 1.0)], [("a", at(20), 1.0)], [("a", at(0.6), 5.0), ("c", at(21), 1.0)]]  # the last "a" is too late
    out = scratch_path(spark, "out")
    pl.run_available(ss.land_sessions(stream(spark, slices, EVENTS), "ts", "1 hour", ["k"], out, scratch_path(spark, "ck"), value="v", watermark="2 hours"))
    got = {(r.k, r.first_ts): (r.n, r.total, r.closed) for r in ss.read_sessions(spark, out, ["k"]).collect()}
    assert got == {("a", at(0)): (2, 2.0, True), ("b", at(3)): (1, 1.0, True), ("b", at(9)): (1, 1.0, True), ("a", at(20)): (1, 1.0, False), ("c", at(21)): (1, 1.0, False)}


def test_session_keys_of_any_type_and_missing_ones(spark):
    schema = "u long, day timestamp, m decimal(18,2), ts timestamp"
    from decimal import Decimal

    rows = [(None, DAY.replace(microsecond=123456), Decimal("1.10"), at(0)), (2 ** 60 + 1, None, None, at(0)), (None, DAY.replace(microsecond=123456), Decimal("1.10"), at(0.2)), (None, None, None, at(5))]
    out = scratch_path(spark, "out")
    keys = ["u", "day", "m"]
    pl.run_available(ss.land_sessions(stream(spark, [rows], schema), "ts", "1 hour", keys, out, scratch_path(spark, "ck")))
    got = sorted(((r.u, r.day, r.m, r.n) for r in ss.read_sessions(spark, out, keys).collect()), key=repr)
    assert got == sorted([(*rows[0][:3], 2), (*rows[1][:3], 1), (*rows[3][:3], 1)], key=repr)
    batch = sorted(((r.u, r.day, r.m, r.n) for r in ss.sessions(spark.createDataFrame(rows, schema), "ts", "1 hour", keys).collect()), key=repr)
    assert batch == got


def test_map_tasks_hold_a_bounded_number_of_reduced_rows(monkeypatch):
    monkeypatch.setattr(keyed, "HELD_ROWS", 50)
    rows = [pd.DataFrame({"account": [f"a{i % 70}" for i in range(200)], "segment": 0, "id": [str(b * 200 + i) for i in range(200)], "ts": range(b * 200, b * 200 + 200),
                          "amount": 1.0, "last_ts": range(b * 200, b * 200 + 200)}) for b in range(5)]
    out = pd.concat(keyed.reduced(rows, dm.first_and_last))
    whole = dm.first_and_last(out.copy())
    assert len(whole) == 70 and whole["ts"].max() < 70 and whole["last_ts"].max() == 999


# --- what a key costs ---------------------------------------------------------------------------

class Handle:
    """The state of one key, and the timers set for it."""

    def __init__(self):
        self.value, self.timers = None, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return self

    def get(self):
        return iter(self.value or []) if self.lists else self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


HOUR = 3_600_000_000


def test_a_key_of_many_sessions_has_one_timer(spark):
    h, step = Handle(), ss.Sessions(HOUR)
    h.lists = True
    step.init(h)
    out = list(step.handleInputRows(("k",), iter([("k", i * 3 * HOUR, i * 3 * HOUR + 5, 2, 1.0) for i in range(50)]), Now(0)))
    assert len(out) == 50 == len(h.value) and {r.closed for r in out} == {False} and len(h.timers) == 1
    assert h.timers[0] == (5 + HOUR) // 1000 + 1  # the earliest end
    closed = list(step.handleExpiredTimer(("k",), Now(30 * HOUR // 1000), None))
    assert [r["first"] for r in closed] == [i * 3 * HOUR for i in range(10)] and all(r.closed for r in closed)
    assert len(h.value) == 40 and h.timers[1:] == [(31 * HOUR + 5) // 1000 + 1]
    # rows that extend an open session set no other timer; what the watermark has passed is closed at once
    out = list(step.handleInputRows(("k",), iter([("k", 147 * HOUR + 9, 147 * HOUR + 9, 1, 4.0)]), Now(100 * HOUR // 1000)))
    assert [(r["last"], r.n, r.total) for r in out if not r.closed] == [(147 * HOUR + 9, 3, 5.0)] and sum(r.closed for r in out) == 23
    assert len(h.timers) == 2 and len(h.value) == 17


def test_an_account_has_one_timer_however_often_it_moves_on(spark):
    h, step = Handle(), dm.RowDormancy(HOUR, 1.0, 10 * HOUR)
    h.lists = False
    step.init(h)
    for batch in range(5):
        rows = [("a", batch, None if batch == 2 else str(batch), batch * 2 * HOUR, None if batch == 3 else 5.0, batch * 2 * HOUR + 7)]
        hits = list(step.handleInputRows(("a",), iter(rows), Now(0)))
        assert [(r.id, r.prev_ts) for r in hits] == ([] if batch in (0, 3) else [(rows[0][2], (batch - 1) * 2 * HOUR + 7)])
    assert h.timers == [(7 + 10 * HOUR) // 1000]
    list(step.handleExpiredTimer(("a",), Now(h.timers[0]), None))
    assert h.value == (8 * HOUR + 7,) and h.timers[1:] == [(8 * HOUR + 7 + 10 * HOUR) // 1000]
    list(step.handleExpiredTimer(("a",), Now(h.timers[1]), None))
    assert h.value is None
