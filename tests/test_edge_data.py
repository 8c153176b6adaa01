"""Edge data: NULL and NaN values, zero totals, faulty messages, stray files, failing reports, stale caches."""

import datetime as dt
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txmon.functions.safe import safe_amount
from txmon.operators import aggregates as agg
from txmon.operators import distribution as dist
from txmon.operators import flatten as fl
from txmon.operators import hierarchy as hier
from txmon.operators import topk
from txmon.operators import windows as win
from txmon.operators.alerts import run_metrics
from txmon.operators.rules import RuleConfig
from txmon.plans import charts
from txmon.plans import reports as rp
from txmon.session import ensure_checkpoint_dir, scratch_path
from txmon.sources import files as fs
from txmon.sources import sinks as sk
from txmon.sources.events import decode_events
from txmon.streaming import monitor as pl
from txmon.streaming import windows as sw

RULES = RuleConfig(high_amount=100.0, sanctioned=("BAD",))
MESSAGES = [
    '{"transaction_id":"ok","timestamp":"2024-01-01T00:00:00","amount_usd":5.0,"sender":{"name":"Ann"}}',
    '{"transaction_id":"high","timestamp":"2024-01-01T01:00:00","amount_usd":500.0,"sender":{"name":{"first":"A"}}}',
    '{"transaction_id":"text","timestamp":"2024-01-01T02:00:00","amount_usd":"2000000","sender_country":"BAD"}',
    '{"transaction_id":"cut","amount_usd":7',
    "not json",
]


def messages(spark):
    rows = [(str(i), m, dt.datetime(2024, 1, 1, i)) for i, m in enumerate(MESSAGES)]
    return spark.createDataFrame(rows, "key string, value string, timestamp timestamp")


# --- messages, routes, alerts -------------------------------------------------------------------

def test_undecodable_messages_are_quarantined(spark):
    from txmon.operators.rules import route

    got = {(r.transaction_id, r.route) for r in route(decode_events(messages(spark)), RULES).collect()}
    assert {("ok", "normal"), ("high", "suspicious"), ("text", "quarantine")} <= got
    assert sum(r == "quarantine" for _, r in got) >= 2  # broken messages share a missing id


def test_object_where_a_scalar_is_expected_is_null_on_both_paths(spark):
    for as_text in (True, False):
        flat = fl.flatten(fl.project_stream(decode_events(messages(spark)), nested_as_text=as_text))
        names = {r.transaction_id: r.sender_name for r in flat.collect()}
        assert names["ok"] == "Ann" and names["high"] is None


def test_alerts_and_tallies_with_faulty_messages(spark):
    src, base, out = (scratch_path(spark, n) for n in ("msgs", "routed", "alerts"))
    # the alert stream may start before anything has been routed
    first = pl.run_available(pl.alert_stream(spark, base, out, scratch_path(spark, "ck")))
    assert first.exception() is None
    messages(spark).repartition(1).write.parquet(src)
    stream = spark.readStream.schema(messages(spark).schema).parquet(src)
    pl.run_available(pl.monitor_stream(stream, base, scratch_path(spark, "ck"), RULES))
    pl.run_available(pl.alert_stream(spark, base, out, scratch_path(spark, "ck")))
    alerts = spark.read.parquet(out).collect()
    assert sorted(a.route for a in alerts) == ["quarantine"] * 3 + ["suspicious"]
    errors = [a.message for a in alerts if a.route == "quarantine"]
    assert all(m.startswith(":x: *ERROR PROCESSING FILE*\nFile: ") for m in errors)
    assert {m.rpartition("Error: ")[2] for m in errors} == set(MESSAGES[2:])
    tallies = run_metrics(fs.read_routed(spark, base)).collect()
    assert sum(t.n_errors for t in tallies) == 3 and sum(t.n_processed for t in tallies) == 2 and len(tallies) >= 3


def test_stray_files_and_missing_folders(spark):
    src, base = scratch_path(spark, "msgs"), scratch_path(spark, "routed")
    assert fs.read_suspicious(spark, base).count() == 0
    messages(spark).repartition(1).write.parquet(src)
    pl.run_available(pl.monitor_stream(spark.readStream.schema(messages(spark).schema).parquet(src), base, scratch_path(spark, "ck"), RULES))
    before = fs.read_suspicious(spark, base).count()
    stray = os.path.join(base.removeprefix("file:"), "route=suspicious", "year=2024", "month=01", "day=01", "part-99999.csv")
    os.makedirs(os.path.dirname(stray), exist_ok=True)
    with open(stray, "w") as f:
        f.write(",".join(fs.ROUTED_COLUMNS) + "\nstray" + "," * (len(fs.ROUTED_COLUMNS) - 1) + "\n")
    assert fs.read_suspicious(spark, base).count() == before == 1
    assert {r.route for r in fs.read_routed(spark, base).collect()} == {"normal", "suspicious", "quarantine"}


def test_csv_with_other_columns_fails_instead_of_being_read_by_position(spark, tmp_path):
    folder = tmp_path / "route=normal" / "year=2024" / "month=01" / "day=01"
    folder.mkdir(parents=True)
    (folder / "x.csv").write_text("amount_usd,transaction_id\n5.0,a\n")
    schema = "transaction_id string, amount_usd string"
    from pyspark.sql.types import StructType

    with pytest.raises(Exception, match="(?i)header"):
        fs.read_routed(spark, str(tmp_path), schema=StructType.fromDDL(schema)).collect()


def test_bounded_run_stops_the_query(spark):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = rate.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "ck")).start()
    pl.run_available(q, timeout_s=2)
    assert not q.isActive


def test_checkpoint_folder_is_required_off_local_masters(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Fake())


# --- loads, cache, reports ----------------------------------------------------------------------

def flat(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, processing_time timestamp, amount double")


def test_incremental_load_inserts_each_key_once(spark):
    path, t = scratch_path(spark, "flat"), dt.datetime(2024, 1, 1)
    sk.load_flat(flat(spark, [("a", t, 1.0), ("c", t, 2.0), ("c", t.replace(day=2), 3.0), (None, t, 9.0)]), path)
    sk.load_flat(flat(spark, [("c", t, 4.0), ("d", t, 5.0), ("d", t, 5.0)]), path)
    assert sorted((r.transaction_id, r.amount) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("c", 2.0), ("d", 5.0)]


def test_a_damaged_table_is_not_a_first_load(spark):
    path, t = scratch_path(spark, "flat"), dt.datetime(2024, 1, 1)
    sk.load_flat(flat(spark, [("a", t, 1.0)]), path)
    for root, _, names in os.walk(path.removeprefix("file:")):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(root, n), "r+b") as f:
                    f.truncate(10)
                crc = os.path.join(root, f".{n}.crc")
                if os.path.exists(crc):
                    with open(crc, "r+b") as f:
                        f.truncate(0)
    with pytest.raises(Exception):
        sk.load_flat(flat(spark, [("a", t, 1.0)]), path)


def test_cache_hits_and_follows_a_replaced_view(spark):
    spark.range(3).createOrReplaceTempView("cached_view")
    sql = "SELECT count(*) AS n FROM cached_view"
    fs.uncache_sql(spark)
    first = fs.cached_sql(spark, sql)
    assert fs.cached_sql(spark, sql) is first and first.first().n == 3
    spark.range(7).createOrReplaceTempView("cached_view")
    assert fs.cached_sql(spark, sql).first().n == 7
    for k in range(fs.CACHE_SIZE + 5):
        fs.cached_sql(spark, f"SELECT {k} AS k")
    assert len(fs._CACHE) == fs.CACHE_SIZE
    fs.uncache_sql(spark)


def test_a_report_that_fails_while_it_runs_is_its_own_error(spark):
    topics = {"bad": "SELECT CAST('x' AS INT) AS v", "good": "SELECT 1 AS v", "none": "SELECT 1 AS v WHERE FALSE", "worse": "SELECT nope"}
    got = {r.topic: (r.status, r.n_rows) for r in rp.report_status(spark, rp.run_reports(spark, topics)).collect()}
    assert got == {"bad": ("error", None), "good": ("ok", 1), "none": ("empty", 0), "worse": ("error", None)}


# --- numbers ------------------------------------------------------------------------------------

def test_safe_amount_reads_what_the_original_reads(spark):
    cells = ["5d", "7f", "5D", "1e3", " 4.5 ", "-2", "", None, "n/a", "inf", "12.", ".5"]
    want = [0.0, 0.0, 0.0, 1000.0, 4.5, -2.0, 0.0, 0.0, 0.0, math.inf, 12.0, 0.5]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert [r.v for r in df.select("i", safe_amount("c").alias("v")).orderBy("i").collect()] == want


def test_running_sum_equals_a_plain_window_with_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1, rng.randint(0, 5), rng.randint(0, 59)), i, rng.choice([None, None, rng.randint(-5, 9)]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id int, v int")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {r.id: r.cumulative_sum for r in win.cumulative(df, "k", "v", ["ts", "id"]).collect()}
    assert got == want


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, nan, 4.0, None)], "g string, v double")
    box = dist.box_stats(df, "g", "v").first()
    q = pd.Series([1.0, 2.0, 4.0]).quantile([0.25, 0.5, 0.75]).tolist()
    assert [box.q1, box.median, box.q3, box.n] == [*q, 3]
    h = dist.histogram(df, "v", 3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 1, 1] and h[0].bin_lo == 1.0 and h[2].bin_hi == 4.0
    d = dist.density_histogram(df, "v", 3).collect()
    assert sum(r.density * (r.bin_hi - r.bin_lo) for r in d) == pytest.approx(1)


def test_zero_totals_give_null_shares(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("b", 0.0, 2)], "k string, v double, id int")
    assert {r.share for r in agg.pie_data(df, "k", "v").collect()} == {None}
    assert {r.share_of_first for r in hier.funnel(df, "k", "v").collect()} == {None}
    assert {r.color for r in hier.treemap(df, ["k"], "v", "v").collect()} == {None}
    assert {r.share for r in win.share_of_total(df, "v").collect()} == {None}


def test_kde_leaves_out_groups_without_spread(spark):
    df = spark.createDataFrame([("same", 2.0)] * 5 + [("one", 7.0)] + [("ok", float(i)) for i in range(20)], "g string, v double")
    out = dist.kde(df, "v", by="g", grid=64).collect()
    assert {r.g for r in out} == {"ok"}
    assert dist.kde(df.filter("g = 'same'"), "v").count() == 0
    pts = sorted((r.x, r.density) for r in dist.violin_grid(df, "g", "v", grid=200, cut=5.0).collect())
    assert np.trapezoid([d for _, d in pts], [x for x, _ in pts]) == pytest.approx(1, abs=0.01)


def test_pivot_of_odd_names_and_missing_values(spark):
    df = spark.createDataFrame([(1, "x.y", 5.0, 1), (None, "z`", 7.0, 2), (1, "x.y", 6.0, 3), (2, None, 1.0, 4)], "x int, y string, v double, id int")
    got = {(r.x, r.y): r.value for r in dist.pivot_heatmap(df, "x", "y", "v", tie="id").collect()}
    assert len(got) == 9 and got[1, "x.y"] == 5.5 and got[None, "z`"] == 7.0 and got[2, None] == 1.0 and got[2, "x.y"] == 0.0


def test_defaults_keep_every_category(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), i) for i in range(50)], "k string, v double, id int")
    assert agg.bar_mean_data(df, "k", "v").count() == 50 and agg.pie_data(df, "k", "v").count() == 50
    assert topk.limit_categories(df, "k", "v").count() == 50
    assert topk.limit_categories(df, "k", "v", 50, 3, tie="id").count() == 3
    assert topk.limit_categories(df, "k", "v", 50, 3, tie="id", at_most=True).count() == 50


# --- streams, charts ----------------------------------------------------------------------------

def test_landed_windows_include_the_open_ones(spark):
    src, out = scratch_path(spark, "src"), scratch_path(spark, "win")
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 30), h) for h in range(6)], "ts timestamp, v int")
    ck = scratch_path(spark, "ck")
    for part in (df.filter("v < 3"), df.filter("v >= 3")):
        part.repartition(1).write.mode("append").parquet(src)
        w = sw.windowed(spark.readStream.schema(df.schema).parquet(src), "ts", "2 hours", value="v")
        pl.run_available(sw.land_windows(w, out, ck))
    got = sorted((r.window_start.hour, r.n, r.total) for r in sw.read_windows(spark, out, ["window_start", "window_end"]).collect())
    assert got == [(0, 2, 1), (2, 2, 5), (4, 2, 9)]


def test_reference_chart_signatures(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, i) for i in range(4)], "k string, x double, y double, z double, id int")
    for kind, kw in [("3D_scatter_plot", dict(x_col="x", y_col="y", z_col="z", color_col="k")), ("area_chart", dict(x_col="x", y_col="y")),
                     ("histogram", dict(col="x")), ("scatter_chart", dict(x_col="x", y_col="y", hue_col="k")),
                     ("bubble_chart", dict(x_col="x", y_col="y", size_col="z", hue_col="k")),
                     ("treemap_chart", dict(path=["k"], value_col="x", color_col="y")), ("pie_counts", dict(pie_col="k")),
                     ("hbar_chart", dict(values="x", names="k", tie="id", num_bars=2)), ("radar_chart", dict(unique_col="k", aggregated_column="x", chart_name="P")),
                     ("violin_chart", dict(x_col="k", y_col="x", box=True, points="all")), ("kde_plot", dict(columns=["x", "y"])),
                     ("correlation_heatmap", dict(non_numeric_cols=["k"])), ("heatmap", dict(x_col="k", y_col="k", values="x", tie="id", num_vals=3))]:
        charts.chart_data(df, kind, title="T", **kw).collect()
    with pytest.raises(ValueError):
        charts.chart_data(df, "scatter_chart", x_col="x", y_col="y", hue_col="nope")


@pytest.mark.parametrize("values", [[1.7e15 + i for i in range(2000)], [5.0 + i * 1e-6 for i in range(2000)], [float(i) for i in range(-1000, 1000)]])
def test_segments_split_a_hot_key_in_a_narrow_range(spark, values):
    from txmon.operators.segmented import default_segment

    df = spark.createDataFrame([("hot", v, i) for i, v in enumerate(values)], "k string, v double, id int")
    sizes = [r["count"] for r in df.withColumn("s", default_segment(df, "v")).groupBy("k", "s").count().collect()]
    assert max(sizes) <= len(values) * 0.02
    got = {r.id: r.cumulative_sum for r in win.cumulative(df.withColumn("one", F.lit(1)), "k", "one", ["v", "id"]).collect()}
    assert [got[i] for i in range(len(values))] == list(range(1, len(values) + 1))
