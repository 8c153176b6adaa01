"""Report surface: chart dispatch validation, per-topic failures, table description."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txmon.plans import charts
from txmon.plans import fixtures as fx
from txmon.plans import reports as rp


def test_chart_dispatch_validates_kind_and_columns(spark):
    t = fx.txn(spark, SF_SMALL)
    with pytest.raises(ValueError, match="unknown chart kind"):
        charts.chart_data(t, "spiral_chart", x_col="channel")
    with pytest.raises(ValueError, match="needs"):
        charts.chart_data(t, "bar_chart", x_col="channel")
    with pytest.raises(ValueError, match="not in the data"):
        charts.chart_data(t, "bar_chart", x_col="nope", y_col="amount_usd")
    with pytest.raises(ValueError, match="not in the data"):
        charts.chart_data(t, "sunburst_chart", path=["channel", "nope"], values="amount_usd")


@pytest.mark.parametrize("kind,kwargs", [
    ("bar_chart", {"x_col": "channel", "y_col": "amount_usd"}),
    ("pie_chart", {"values": "amount_usd", "names": "transaction_type", "tie": "transaction_id"}),
    ("histogram", {"x_col": "amount_usd", "bins": 5}),
    ("sunburst_chart", {"path": ["sender_country", "channel"], "values": "amount_usd"}),
    ("treemap_chart", {"path": ["sender_country"], "values_col": "amount_usd", "color_col": "fee_usd"}),
    ("kde_plot", {"x_col": "amount_usd", "hue_col": "channel"}),
    ("violin_chart", {"x_col": "channel", "y_col": "amount_usd"}),
    ("funnel_chart", {"x_col": "amount_usd", "y_col": "status"}),
    ("density_heatmap", {"x_col": "amount_usd", "y_col": "fee_usd"}),
    ("radar_chart", {"unique_col": "channel", "aggregated_column": "amount_usd"}),
    ("area_chart", {"category_col": "channel", "value_col": "amount_usd", "order": ["transactiondate", "transaction_id"]}),
    ("choropleth_map", {"location_column": "receiver_country", "color_column": "amount_usd"}),
    ("correlation_heatmap", {"exclude": []}),
])
def test_every_chart_kind_builds_data(spark, kind, kwargs):
    t = fx.txn(spark, SF_SMALL)
    assert charts.chart_data(t, kind, **kwargs).count() > 0


def test_failed_topic_does_not_stop_the_others(spark):
    fx.txn(spark, SF_SMALL).createOrReplaceTempView("txn")
    reports = rp.run_reports(spark, {"ok": "SELECT channel, COUNT(*) AS n FROM txn GROUP BY channel",
                                     "bad": "SELEC oops", "none": "SELECT * FROM txn WHERE 1 = 0"})
    assert isinstance(reports["bad"], Exception)
    status = {r.topic: (r.status, r.n_rows) for r in rp.report_status(spark, reports).collect()}
    assert status == {"ok": ("ok", 4), "bad": ("error", None), "none": ("empty", 0)}


def test_describe_table_counts_per_column(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 2.5), ("b", None, 3.5)], "s string, i int, d double")
    got = {r.column_name: (r.data_type, r.null_count, r.distinct_count, r.min_value, r.max_value, r.row_count)
           for r in rp.describe_table(df, exact_distinct=True).collect()}
    assert got == {"s": ("string", 0, 2, "a", "b", 3), "i": ("int", 1, 1, "1", "1", 3),
                   "d": ("double", 1, 2, "2.5", "3.5", 3)}
    approx = {r.column_name: r.distinct_count for r in rp.describe_table(df).collect()}
    assert approx == {"s": 2, "i": 1, "d": 2}


def test_charts_keep_every_category_unless_asked(spark):
    df = spark.createDataFrame([(f"c{k:02d}", float(k)) for k in range(30)], "x string, y double")
    bars = charts.chart_data(df, "bar_mean_chart", x_col="x", y_col="y")
    assert bars.count() == 30
    assert charts.chart_data(df, "bar_mean_chart", x_col="x", y_col="y", max_x=20).count() == 20
    assert charts.chart_data(df, "pie_chart", names="x", values="y").count() == 30
    assert charts.chart_data(df, "pie_chart", names="x", values="y", max_categories=10).count() == 10


def test_exact_distinct_counts_shuffle_short_rows(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None, [float("nan"), 0.0, -0.0, 1.5, None][i % 5], dt.datetime(2024, 1, 1 + i % 3), Decimal(i % 4), [i % 2], bool(i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, `a.b` string, f double, ts timestamp, d decimal(9,2), l array<int>, b boolean").withColumn("none", F.lit(None).cast("string")).withColumn("other", F.col("ts"))
    exact = rp.describe_table(df, exact_distinct=True)
    got = {r.column_name: (r.distinct_count, r.null_count, r.row_count) for r in exact.collect()}
    assert got == {"id": (100, 0, 100), "a.b": (7, 20, 100), "f": (3, 20, 100), "ts": (3, 0, 100), "d": (4, 0, 100), "l": (2, 0, 100), "b": (2, 0, 100), "none": (0, 100, 100), "other": (3, 0, 100)}
    want = df.select(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    assert {c: n for c, (n, _, _) in got.items()} == want
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()  # each row was copied whole for each column, and sorted
    assert [r.distinct_count for r in rp.describe_table(df.limit(0), exact_distinct=True).collect()] == [0] * 9
