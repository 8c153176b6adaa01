"""Loads that read only the folders their keys may be in, and compaction beside a stream's commit log."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from txmon.operators.rules import RuleConfig
from txmon.session import scratch_path
from txmon.sources import compaction as cp
from txmon.sources import files as fs
from txmon.sources import keyindex as ki
from txmon.sources import sinks as sk
from txmon.streaming import monitor as pl
from txmon.streaming import windows as sw

DAY = dt.datetime(2024, 1, 1)


def flat(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, processing_time timestamp, amount double")


def day(n, hour=0):
    return DAY + dt.timedelta(days=n, hours=hour)


def test_the_index_never_misses_a_key_and_rarely_names_another_period(spark):
    rows = spark.createDataFrame([(f"2024-01-{1 + i % 20:02}", f"key-{i}") for i in range(30000)], "period string, key string")
    index = ki.index_of(rows)
    stored = index.collect()
    assert {r.period for r in stored} == {f"2024-01-{d:02}" for d in range(1, 21)} and all(len(r.bits) * 8 == ki.BITS for r in stored)
    index = spark.createDataFrame(stored, index.schema)
    more = ki.index_of(rows.filter("key < 'key-2'").withColumn("period", F.lit("2024-02-01")))  # a second load of other size
    both = index.unionByName(more).persist()
    found = ki.candidates(rows.select("key"), both).join(rows, ["key", "period"])
    assert found.count() == 30000
    strangers = spark.range(20000).select(F.concat(F.lit("new-"), "id").alias("key"))
    assert ki.candidates(strangers, both).count() < 20000 * 21 * 0.01
    assert ki.candidates(strangers, both.limit(0)).count() == 0


def test_a_load_reads_only_folders_that_may_hold_its_keys(spark):
    path = scratch_path(spark, "flat")
    first = [(f"k{d}-{i}", day(d), float(i)) for d in range(30) for i in range(40)]
    assert sk.load_by_period(flat(spark, first), path) == {"stored": 0, "read": 0}
    new = [(f"n{d}-{i}", day(d), 1.0) for d in range(28, 33) for i in range(40)]
    report = sk.load_by_period(flat(spark, new), path)
    assert report["stored"] == 30 and report["read"] <= 5  # a chance hit may name a folder
    late = [("k3-7", day(40), 9.0), ("k17-0", day(2), 9.0), ("fresh", day(3), 2.0), ("fresh", day(1), 3.0), (None, day(1), 1.0)]
    report = sk.load_by_period(flat(spark, late), path)
    assert report["stored"] == 33 and 2 <= report["read"] <= 6
    table = spark.read.parquet(path)
    got = {r.transaction_id: (r.processing_time, r.amount) for r in table.collect()}
    assert table.count() == len(got) and got == {**{k: (t, v) for k, t, v in first + new}, "fresh": (day(1), 3.0)}


def test_random_loads_equal_the_plain_incremental_load(spark):
    rng = random.Random(3)
    a, b = scratch_path(spark, "by-day"), scratch_path(spark, "plain")
    for _ in range(4):
        rows = [(rng.choice([None, "é"] + [f"k{rng.randrange(150)}" for _ in range(20)]), rng.choice([None, day(rng.randrange(12), rng.randrange(24))]), rng.random()) for _ in range(120)]
        sk.load_by_period(flat(spark, rows), a, period="yyyy-MM-dd")
        sk.load_flat(flat(spark, rows), b)
    key = lambda p: sorted(((r.transaction_id, r.processing_time, r.amount) for r in spark.read.parquet(p).collect()), key=repr)
    assert key(a) == key(b)


def test_a_load_that_failed_after_its_index_is_repeated_whole(spark):
    path = scratch_path(spark, "flat")
    rows = flat(spark, [("a", day(0), 1.0), ("b", day(1), 2.0)])
    ki.index_of(rows.select(F.lit("2024-01-01").alias("period"), F.col("transaction_id").alias("key"))).write.parquet(f"{path}_keys")
    sk.load_by_period(rows, path)
    sk.load_by_period(rows, path)
    assert sorted(r.transaction_id for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_only_the_named_folders_are_scanned(spark):
    path = scratch_path(spark, "flat")
    sk.load_by_period(flat(spark, [(f"k{d}", day(d), 1.0) for d in range(10)]), path)
    schema = "transaction_id string, load_period string"
    plan = spark.read.schema(schema).parquet(path).filter(F.col("load_period").isin(["2024-01-03"])).select("transaction_id")
    text = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "load_period" in text[text.index("PartitionFilters: ["):].split("]")[0]
    assert plan.select(F.input_file_name().alias("f")).distinct().count() == 1


# --- compaction ---------------------------------------------------------------------------------

def n_files(path):
    return sum(n.endswith((".csv", ".parquet")) for _, _, names in os.walk(path.removeprefix("file:")) for n in names)


def messages(spark, lo, hi):
    rows = [(str(i), '{"transaction_id":"t%d","amount_usd":%d}' % (i, i % 7) if i % 11 else "broken", day(i % 40)) for i in range(lo, hi)]
    return spark.createDataFrame(rows, "key string, value string, timestamp timestamp")


def table(df):
    return sorted((tuple(str(v) for v in r) for r in df.drop("source_file").collect()), key=repr)


def test_routed_folder_reads_the_same_with_fewer_files(spark):
    src, base, packed, ck = (scratch_path(spark, n) for n in ("src", "routed", "packed", "ck"))
    rules = RuleConfig(high_amount=5.0)
    assert cp.compact_routed(spark, base, packed) == 0 and cp.read_routed_compacted(spark, base, packed).count() == 0
    for part in range(3):
        messages(spark, part * 100, part * 100 + 100).repartition(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(messages(spark, 0, 1).schema).parquet(src)
        pl.run_available(pl.monitor_stream(stream, base, ck, rules))
        if part == 1:
            before = table(fs.read_routed(spark, base))
            small = n_files(base)
            # a failed batch's file is in no commit log and must not be packed
            stray = os.path.join(base.removeprefix("file:"), "route=normal", "year=2024", "month=01", "day=01", "part-stray.csv")
            with open(stray, "w") as f:
                f.write(",".join(fs.ROUTED_COLUMNS) + "\nstray" + "," * (len(fs.ROUTED_COLUMNS) - 1) + "\n")
            assert cp.compact_routed(spark, base, packed) == small
            assert table(cp.read_routed_compacted(spark, base, packed)) == before and n_files(packed + "/rows") <= small / 5
            assert cp.compact_routed(spark, base, packed) == 0
    live, both = fs.read_routed(spark, base), cp.read_routed_compacted(spark, base, packed)
    assert both.columns == live.columns and table(both) == table(live) and live.count() == 300
    assert both.select("source_file").distinct().count() == live.select("source_file").distinct().count()
    cp.compact_routed(spark, base, packed)
    assert table(cp.read_routed_compacted(spark, base, packed)) == table(live)


def test_an_unfinished_generation_is_not_read_and_is_replaced(spark):
    folder, packed = scratch_path(spark, "batches"), scratch_path(spark, "packed")
    for n in range(4):
        spark.range(n * 10, n * 10 + 10).repartition(3).write.parquet(f"{folder}/batch_id={n}")
    spark.range(5).withColumn("batch_id", F.lit(0)).write.parquet(f"{packed}/rows/generation=000000")  # no list: it never finished
    want = sorted((r.id, r.batch_id) for r in spark.read.parquet(folder).collect())
    assert sorted((r.id, r.batch_id) for r in cp.read_batches(spark, folder, packed).collect()) == want
    assert cp.compact_batches(spark, folder, packed) == 3  # the newest batch may still be replayed
    assert sorted((r.id, r.batch_id) for r in cp.read_batches(spark, folder, packed).collect()) == want
    spark.range(100, 103).write.mode("overwrite").parquet(f"{folder}/batch_id=3")
    spark.range(200, 203).write.parquet(f"{folder}/batch_id=4")
    assert cp.compact_batches(spark, folder, packed) == 1
    got = sorted(r.id for r in cp.read_batches(spark, folder, packed).collect())
    assert got == [*range(30), 100, 101, 102, 200, 201, 202]


@pytest.mark.parametrize("upto", [1, 3])
def test_windows_read_the_same_when_packed(spark, upto):
    src, out, packed, ck = (scratch_path(spark, n) for n in ("src", "windows", "packed", "ck"))
    keys = ["window_start", "window_end"]
    for part in range(4):
        rows = [(day(0, h % 9), h) for h in range(part * 5, part * 5 + 20)]
        spark.createDataFrame(rows, "ts timestamp, v int").repartition(1).write.mode("append").parquet(src)
        w = sw.windowed(spark.readStream.schema("ts timestamp, v int").parquet(src), "ts", "2 hours", value="v", watermark="2 days")
        pl.run_available(sw.land_windows(w, out, ck))
        if part == upto:
            assert sw.compact_windows(spark, out, keys, packed) >= upto  # a batch without data may land too
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(sw.read_windows(spark, out, keys, packed)) == rows(sw.read_windows(spark, out, keys))
    packed_rows = spark.read.parquet(f"{packed}/rows")
    assert packed_rows.count() == packed_rows.select(*keys).distinct().count()


def test_coarser_folders_hold_the_day_as_a_column(spark):
    base, fine = scratch_path(spark, "coarse"), scratch_path(spark, "fine")
    rows = spark.createDataFrame([(f"t{i}", day(i % 40).isoformat(), float(i % 9), "AA", "BB") for i in range(80)],
                                 "transaction_id string, timestamp string, amount_usd double, sender_country string, receiver_country string")
    names = ["transaction_id", "timestamp", "amount_usd", "sender_country", "receiver_country"]
    schema = ", ".join(f"{c} string" for c in [*names, "flag_reasons"])
    sk.write_routed(rows, fine, RuleConfig(high_amount=5.0), partition_by="event")
    sk.write_routed(rows, base, RuleConfig(high_amount=5.0), partition_by="event", folders=["route", "year", "month"])
    coarse = fs.read_routed(spark, base, schema=schema + ", day string")
    assert table(coarse.select(*fs.read_routed(spark, fine, schema=schema).columns)) == table(fs.read_routed(spark, fine, schema=schema))
    assert n_files(base) < n_files(fine) / 5


def test_periods_that_may_hold_keys_are_found_without_asking_every_key_of_each(spark, monkeypatch):
    rows = spark.createDataFrame([(f"2024-01-{1 + i % 20:02}", f"key-{i}") for i in range(8000)] + [("rare", "key-rare"), ("none", "key-none")], "period string, key string")
    index = spark.createDataFrame(ki.index_of(rows).collect(), ki.SCHEMA).persist()
    asked, plain = [], ki.candidates
    monkeypatch.setattr(ki, "candidates", lambda keys, periods: asked.append((keys.count(), {r.period for r in periods.select("period").distinct().collect()})) or plain(keys, periods))
    keys = rows.filter("key <> 'key-none'").select("key")
    got = ki.candidate_periods(keys, index)
    want = {r.period for r in plain(keys, index).select("period").distinct().collect()}
    assert set(got) == want and got == sorted(got) and {f"2024-01-{d:02}" for d in range(1, 21)} | {"rare"} <= want
    (few, every), (all_keys, others) = asked
    assert few < 8001 / 30 and len(every) == 22 and all_keys == 8001 and others <= {"rare", "none"}
    assert ki.candidate_periods(keys.limit(0), index) == [] == ki.candidate_periods(keys, index.limit(0))
    assert "lambda" not in plain(keys, index)._jdf.queryExecution().executedPlan().toString()  # compiled: bitmaps are not copied per key
    index.unpersist()
