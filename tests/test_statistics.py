"""Quantiles by brackets, infinities in statistics, bootstrap intervals, stored distinct counts, late rows."""

import datetime as dt
import hashlib
import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txmon.operators import aggregates as agg
from txmon.operators import distribution as dist
from txmon.operators import windows as win
from txmon.session import scratch_path
from txmon.streaming import monitor as pl
from txmon.streaming import windows as sw

INF, NAN = math.inf, math.nan
KINDS = {
    "normal": lambda r, n: r.normal(0, 1e3, n),
    "heavy": lambda r, n: np.exp(r.normal(0, 12, n)),
    "ties": lambda r, n: r.integers(0, 4, n).astype(float),
    "one": lambda r, n: np.full(n, 7.0),
    "steps": lambda r, n: np.where(r.random(n) < 0.5, -1e300, 1e300),
    "infinite": lambda r, n: np.where(r.random(n) < 0.3, np.where(r.random(n) < 0.5, INF, -INF), r.normal(0, 1, n)),
    "ranks": lambda r, n: r.permutation(n).astype(float),
}


def frame(spark, data):
    return spark.createDataFrame(pd.DataFrame([(g, float(v)) for g, vs in data.items() for v in vs], columns=["g", "v"])).repartition(5)


@pytest.mark.parametrize("qs", [(0.25, 0.5, 0.75), (0.0, 0.001, 0.999, 1.0)])
def test_quantiles_equal_pandas(spark, qs):
    rng = np.random.default_rng(5)
    data = {k: f(rng, n) for k, f in KINDS.items() for n in (1,)} | {f"{k}{n}": f(rng, n) for k, f in KINDS.items() for n in (2, 3, 37, 4000, 4001, 9001)}
    got = {(r.g, r.q): r.quantile for r in dist.exact_quantiles(frame(spark, data), "g", "v", qs).collect()}
    assert len(got) == len(data) * len(qs)
    for (g, q), v in got.items():
        ordered = np.sort(data[g])
        pos = q * (len(ordered) - 1)
        lo, hi = ordered[math.floor(pos)], ordered[math.ceil(pos)]
        want = lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos))
        assert v == pytest.approx(want, rel=1e-12) or (math.isnan(want) and math.isnan(v)), (g, q)
        if np.isfinite(data[g]).all() and g[:5] != "steps":
            assert v == pytest.approx(pd.Series(data[g]).quantile(q), rel=1e-9, abs=1e-12)


def test_box_statistics_take_two_scans_and_shuffle_little(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, {"hot": rng.normal(0, 1, 60000), "b": rng.normal(3, 1, 20000)})
    path = scratch_path(spark, "values")
    df.write.parquet(path)
    box = dist.box_stats(spark.read.parquet(path), "g", "v")
    rows = {r.g: r for r in box.collect()}
    assert rows["hot"].n == 60000 and rows["hot"].median == pytest.approx(float(spark.read.parquet(path).filter("g = 'hot'").toPandas().v.median()))
    small = dist.bracketed(df, ["g"], "v", dist.QUARTILES, dist.sketched(df, ["g"], "v", dist.QUARTILES))
    assert small.count() < 0.03 * 80000 and small.agg(F.sum("_c")).first()[0] == 80000
    final = box._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") - final.count("ReusedExchange") <= 2 or final.count("Scan parquet") <= 4


def test_rows_of_a_hot_group_are_not_shuffled_to_meet_their_brackets(spark):
    df = spark.range(60000, numPartitions=6).select(F.when(F.col("id") >= 0, "all").alias("g"), ((F.col("id") * 7919) % 60000).cast("double").alias("v"))
    rows = dist.bracketed(df, ["g"], "v", dist.QUARTILES, dist.sketched(df, ["g"], "v", dist.QUARTILES))
    assert rows.agg(F.sum("_c")).first()[0] == 60000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table, whose statistics have no known size
    try:
        plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    box = dist.box_stats(df, "g", "v").first()
    assert (box.n, box.min, box.q1, box.median, box.q3, box.max) == (60000, 0.0, 14999.75, 29999.5, 44999.25, 59999.0)


def test_groups_without_brackets_have_the_same_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = {f"g{i}": rng.normal(i, 1, 5000) for i in range(3)} | {"few": rng.normal(0, 1, 5)}
    df = frame(spark, data).withColumn("g", F.nullif("g", F.lit("g1")))
    quantiles = lambda: {(r.g, r.q): r.quantile for r in dist.exact_quantiles(df, "g", "v").collect()}
    want = quantiles()
    monkeypatch.setattr(dist, "BRACKETED", 2)  # no group has half of all rows
    st = dist.sketched(df, ["g"], "v", dist.QUARTILES)
    assert dist.bracketed(df, ["g"], "v", dist.QUARTILES, st).count() == 15005
    assert quantiles() == want and want[(None, 0.5)] == pytest.approx(np.median(data["g1"]))


def test_infinities_are_left_out_of_bins_and_densities(spark):
    values = [1.0, 2.0, 3.0, 4.0, INF, -INF, NAN, None]
    df = spark.createDataFrame([("g", v, v) for v in values], "g string, v double, w double")
    h = sorted((r.bin, r.bin_lo, r.bin_hi, r["count"]) for r in dist.histogram(df, "v", 3).collect())
    assert h == [(0, 1.0, 2.0, 1), (1, 2.0, 3.0, 1), (2, 3.0, 4.0, 2)]
    cells = dist.density_heatmap(df, "v", "w", 3, 3).filter("level = 0").agg(F.sum("count")).first()[0]
    assert cells == 4
    finite = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0)], "g string, v double")
    for by in (None, "g"):
        curve = lambda d: [(r.grid_index, r.x, r.density) for r in dist.kde(d, "v", by, grid=16).orderBy("grid_index").collect()]
        assert curve(df) == curve(finite) and len(curve(df)) == 16 and not any(math.isnan(c[2]) for c in curve(df))
    box = dist.box_stats(df, "g", "v").first()
    assert (box.min, box.max, box.n, box.median) == (-INF, INF, 6, 2.5)
    assert sum(r["count"] for r in dist.histogram(spark.createDataFrame([(INF,), (NAN,)], "v double"), "v", 3).collect()) == 0
    wide = spark.createDataFrame([(-1.7e308,), (-1.0,), (1.0,), (1.7e308,)], "v double")
    assert [r["count"] for r in dist.histogram(wide, "v", 4).orderBy("bin").collect()] == [1, 1, 1, 1] or \
        sum(r["count"] for r in dist.histogram(wide, "v", 4).collect()) == 4


def test_running_sums_over_infinite_and_extreme_orders(spark):
    rng = random.Random(7)
    pool = [INF, -INF, NAN, None, 0.0, -0.5, 1e-320, 1.7e308, -1.7e308, 5e17] + [rng.gauss(0, 100) for _ in range(60)]
    rows = [(rng.choice(["a", "b", None]), rng.choice(pool), i, rng.randint(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o double, id int, v int")
    w = Window.partitionBy("k").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {r.id: r.cumulative_sum for r in win.cumulative(df, "k", "v", ["o", "id"]).collect()}
    assert got == want


# --- bootstrap ----------------------------------------------------------------------------------

def test_bootstrap_repeats_its_hashes(spark):
    rng = random.Random(1)
    rows = [(f"id{i}", rng.choice(["a", "b"]), rng.choice([None, NAN, *[float(rng.randrange(90)) for _ in range(8)]])) for i in range(300)] + [("solo", "c", 4.0), ("none", "d", None)]
    df = spark.createDataFrame(rows, "id string, x string, y double")
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]

    def weight(i, b):
        digest = hashlib.md5(f"{i}:3:{b // 8}".encode()).hexdigest()
        return sum(int(digest[4 * (b % 8):4 * (b % 8) + 4], 16) >= math.floor(65536 * c) for c in cdf)

    got = {r.x: r for r in agg.line_mean_bootstrap(df, "x", "y", "id", n_boot=203, seed=3).collect()}
    assert set(got) == {"a", "b", "c"}
    for x, r in got.items():
        kept = [(i, y) for i, k, y in rows if k == x and y is not None and not math.isnan(y)]
        means = []
        for b in range(203):
            w = [weight(i, b) for i, _ in kept]
            if sum(w):
                means.append(sum(k * y for k, (_, y) in zip(w, kept)) / sum(w))
        lo, hi = np.percentile(means, [2.5, 97.5])
        assert (r.n, r.ci_low, r.ci_high) == (len(kept), pytest.approx(lo), pytest.approx(hi)) and r.mean == pytest.approx(np.mean([y for _, y in kept]))


def test_bootstrap_interval_is_about_the_normal_one_and_weights_are_poisson(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": [str(i) for i in range(4000)], "x": 1, "y": rng.exponential(10, 4000)})
    df = spark.createDataFrame(pdf)
    r = agg.line_mean_bootstrap(df, "x", "y", "id").first()
    half = 1.96 * pdf.y.std() / math.sqrt(4000)
    assert r.ci_high - r.ci_low == pytest.approx(2 * half, rel=0.1) and r.ci_low < pdf.y.mean() < r.ci_high
    w = df.select(F.explode(F.array(*agg.poisson_weights(F.col("id"), F.lit(5), 0))).alias("w")).groupBy("w").count().collect()
    assert {r.w: r["count"] / 32000 for r in w if r.w < 4} == pytest.approx({k: math.exp(-1) / math.factorial(k) for k in range(4)}, abs=0.01)


def test_bootstrap_digests_each_block_of_a_row_once(monkeypatch):
    # 72 digests were taken for the eight replicates of one block, in one task for one file
    seen = []
    monkeypatch.setattr(agg, "md5", lambda text: seen.append(text) or hashlib.md5(text))
    batch = pa.RecordBatch.from_arrays([pa.array([2020, None, 2020]), pa.array([b"a", b"b", b"c"]), pa.array([Decimal("-123456789012345.67"), Decimal("0.01"), Decimal("99.99")], pa.decimal128(18, 2))],
                                       names=["_x", "_id", "_y"])
    out = pa.Table.from_batches(agg._weighted_sums(iter([batch, batch.slice(1)]), 20, 0)).to_pylist()
    assert len(seen) == 5 * 3 and len(out) == 2 * 20  # three blocks of eight for 20 replicates
    reached = [math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
    w = lambda i, b: sum(int(hashlib.md5(f"{i}:0:{b // 8}".encode()).hexdigest()[4 * (b % 8):][:4], 16) >= t for t in reached)
    for r in out:
        rows = [("b", "0.01", 2)] if r["_x"] is None else [("a", "-123456789012345.67", 1), ("c", "99.99", 2)]
        assert (r["_s"], r["_n"]) == (sum(k * w(i, r["_b"]) * Decimal(v) for i, v, k in rows), sum(k * w(i, r["_b"]) for i, _, k in rows))


def test_bootstrap_work_is_spread_and_keeps_exact_sums_of_any_number(spark):
    rows = [(i, i % 3, Decimal(10**15 + i), float(i), 2**53 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x int, d decimal(38,2), f double, l long").coalesce(1)
    got = {y: sorted((r.x, r.n, r.ci_low, r.ci_high) for r in agg.line_mean_bootstrap(df, "x", y, "id", n_boot=40).collect()) for y in ("d", "f", "l")}
    plan = agg.line_mean_bootstrap(df, "x", "d", "id")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan[plan.index("MapInArrow"):]
    for k in range(3):
        low = got["f"][k][2]
        assert got["d"][k][1] == 20 and got["d"][k][2] - 10**15 == pytest.approx(low, abs=0.2) and got["l"][k][2] - 2**53 == pytest.approx(low, abs=2)


# --- distinct counts of loads -------------------------------------------------------------------

def test_stored_sketches_merge_and_a_repeated_load_counts_once(spark):
    path = scratch_path(spark, "sketches")
    load = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("a.b"), (F.col("id") % 50).alias("few"), F.lit(None).cast("string").alias("none"))
    for lo, hi, name in ((0, 30000, "one"), (20000, 60000, "two"), (20000, 60000, "two")):
        agg.store_distinct(load(lo, hi), ["a.b", "few", "none"], path, name)
    got = {r.column_name: r for r in agg.stored_distinct(spark, path).collect()}
    assert got["a.b"].n_distinct == pytest.approx(60000, rel=0.03) and got["few"].n_distinct == 50 and got["none"].n_distinct == 0
    assert {r.n_loads for r in got.values()} == {2} and {r.n_rows for r in got.values()} == {70000}


# --- late rows ----------------------------------------------------------------------------------

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_landed_windows_and_late_rows_are_all_rows(spark, slide):
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[("a", at(h), 1.0) for h in (0, 1, 2.5)], [("b", at(9), 2.0), ("a", at(1.2), 4.0)], [("late", at(1.5), 8.0), ("edge", at(7.0), 16.0), ("half", at(7.75), 32.0), ("on", at(8.1), 128.0), ("null", None, 64.0)]]
    src, out, late, ck = (scratch_path(spark, n) for n in ("src", "parts", "late", "ck"))
    schema = "k string, ts timestamp, v double"
    for rows in batches:  # a restart between batches
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(schema).parquet(src)
        pl.run_available(sw.land_windows_and_late(s, "ts", "1 hour", "k", out, late, ck, value="v", slide=slide, delay="1 hour"))
    lost = {r.k for r in spark.read.parquet(f"{late}/rows").collect()}
    assert lost == {"late", "null", "edge"} | ({"half"} if slide is None else set())  # by 08:00 the window from 07:00 has ended
    parts = sw.read_window_parts(spark, out, ["window_start", "window_end", "k"])
    landed = parts.agg(F.sum("n"), F.sum("total")).first()
    copies = 1 if slide is None else 2
    everything = [r for rows in batches for r in rows]
    kept = [r for r in everything if r[0] not in lost]
    assert tuple(landed) == (copies * len(kept), copies * sum(v for _, _, v in kept))
    assert spark.read.parquet(f"{late}/rows").count() + len(kept) == len(everything)
    assert all(r.window_end - r.window_start == dt.timedelta(hours=1) for r in parts.collect())
