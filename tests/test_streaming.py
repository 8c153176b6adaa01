"""Streams: resume from checkpoint, stream = batch, late data, re-delivery."""

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txmon.operators import rules
from txmon.plans import fixtures as fx
from txmon.plans.params import EVENT_RULES
from txmon.session import scratch_path
from txmon.sources.files import read_routed
from txmon.streaming import dormancy as dm
from txmon.streaming import monitor as pl
from txmon.streaming import windows as sw


def _slice_writer(spark, events, path):
    t = F.col("ts").cast("timestamp").cast("double")
    lo, hi = events.select(F.min(t), F.max(t)).first()
    b = F.least(F.floor((t - lo) * 4 / (hi - lo)), F.lit(3))

    def write(i):
        events.filter(b == i).coalesce(1).write.parquet(f"{path}/slice_{i}")
    return write


def test_restart_resumes_without_loss_or_duplicates(spark):
    events = fx.table(spark, SF_SMALL, "events")
    src = scratch_path(spark, "src")
    write = _slice_writer(spark, events, src)
    base, ck = scratch_path(spark, "routed"), scratch_path(spark, "ck")

    def run():
        stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(src))
        return pl.run_available(pl.monitor_stream(fx.events_to_messages(stream), base, ck, EVENT_RULES))

    write(0), write(1)
    q1 = run()
    first = read_routed(spark, base).count()
    write(2), write(3)
    q2 = run()
    landed = read_routed(spark, base)
    assert first < events.count()
    assert landed.count() == events.count()
    assert landed.select("transaction_id").distinct().count() == events.count()
    assert len(q1.recentProgress) >= 2 and len(q2.recentProgress) >= 2


def test_dormancy_stream_equals_batch_lag(spark):
    events = fx.table(spark, SF_SMALL, "events")
    src = scratch_path(spark, "src")
    write = _slice_writer(spark, events, src)
    for i in range(4):
        write(i)
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    flagged = dm.dormant_stream(stream, "user_id", "ts", "value", "event_id", 6 * 3600, 50.0)
    out, ck = scratch_path(spark, "dorm"), scratch_path(spark, "ck")
    pl.run_available(flagged.writeStream.format("parquet").option("path", out)
                     .option("checkpointLocation", ck).trigger(availableNow=True).start())
    got = {r.id for r in spark.read.parquet(out).collect()}
    batch = rules.flag_dormant(events.withColumn("tid", F.col("event_id").cast("string")), "user_id", "ts",
                               "value", "tid", 6 * 3600, 50.0)
    want = {r.tid for r in batch.filter("is_dormant_burst").collect()}
    assert got == want and len(got) > 0


def _write_rows(spark, rows, path):
    spark.createDataFrame(rows, "id string, ts timestamp, v double").coalesce(1).write.parquet(path)


def test_late_rows_are_dropped_by_the_watermark(spark):
    src = scratch_path(spark, "late")
    day = dt.datetime(2024, 1, 1)
    _write_rows(spark, [("a", day + dt.timedelta(days=d), 1.0) for d in range(10)], f"{src}/b0")
    schema = "id string, ts timestamp, v double"
    out, ck = scratch_path(spark, "late-out"), scratch_path(spark, "ck")

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        w = sw.windowed(s, "ts", "1 day", value="v", watermark="1 hour")
        return pl.run_available(w.writeStream.format("parquet").option("path", out)
                                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    run()
    _write_rows(spark, [("late", day, 5.0), ("new", day + dt.timedelta(days=11), 1.0)], f"{src}/b1")
    q = run()
    res = spark.read.parquet(out)
    first_day = res.filter(F.col("window_start") == day).collect()
    assert len(first_day) == 1 and first_day[0].n == 1  # the late row did not change day 1
    assert pl.dropped_by_watermark(q) >= 1


def test_redelivered_copies_are_dropped(spark):
    src = scratch_path(spark, "dedup")
    t0 = dt.datetime(2024, 1, 1)
    _write_rows(spark, [("x", t0, 1.0), ("y", t0, 2.0)], f"{src}/b0")
    out, ck = scratch_path(spark, "dedup-out"), scratch_path(spark, "ck")

    def run():
        s = spark.readStream.schema("id string, ts timestamp, v double").option("recursiveFileLookup", "true").parquet(src)
        d = sw.dedup_stream(s, "id", "ts", "1 day")
        return pl.run_available(d.writeStream.format("parquet").option("path", out)
                                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    run()
    _write_rows(spark, [("x", t0 + dt.timedelta(minutes=5), 1.0), ("z", t0, 3.0)], f"{src}/b1")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]


def test_staged_slices_arrive_one_whole_slice_per_micro_batch(spark):
    events = fx.table(spark, SF_SMALL, "events")
    path = fx.stage_time_slices(events, "ts", scratch_path(spark, "slices"), 4, 3)
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3)
              .option("recursiveFileLookup", "true").parquet(path))
    out, ck = scratch_path(spark, "slice-bounds"), scratch_path(spark, "ck")

    def bounds(batch, batch_id):
        batch.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")) \
             .withColumn("b", F.lit(batch_id)).write.mode("append").parquet(out)

    pl.run_available(stream.writeStream.foreachBatch(bounds).option("checkpointLocation", ck)
                     .trigger(availableNow=True).start())
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r.b)
    assert len(rows) == 4 and sum(r.n for r in rows) == events.count()
    assert all(a.hi <= b.lo for a, b in zip(rows, rows[1:]))  # event-time order across micro-batches
