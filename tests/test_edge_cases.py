"""Edge cases of FIXTURES section 3 on small literal frames."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from txmon.functions.jsonpath import json_scalar
from txmon.functions.money import expected_fee, format_usd
from txmon.functions.safe import safe_amount, safe_person
from txmon.operators import aggregates as agg
from txmon.operators import distribution as dist
from txmon.operators import hierarchy as hier
from txmon.operators import reconcile as rec
from txmon.operators import rules
from txmon.operators import topk
from txmon.operators.alerts import alert_messages
from txmon.operators.flatten import flatten, project_stream, validate
from txmon.operators.segmented import previous_value, running_sum
from txmon.session import scratch_path
from txmon.sources import files as fs
from txmon.sources import sinks as sk
from txmon.sources.events import decode_events


# ------------------------------------------------------------------ rules
def test_amount_threshold_is_inclusive_and_null_is_zero(spark):
    df = spark.createDataFrame([(1, 1_000_000.0), (2, 999_999.99), (3, None)], "id int, amount_usd double")
    got = {r.id: r.h for r in df.select("id", rules.is_high_amount().alias("h")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_sanction_match_is_exact_and_null_safe(spark):
    df = spark.createDataFrame([(1, "PRK", None), (2, "prk", "USA"), (3, None, None), (4, "USA", "CUB")],
                               "id int, sender_country string, receiver_country string")
    got = {r.id: r.s for r in rules.flag_suspicious(df.withColumn("amount_usd", F.lit(None).cast("double")))
           .select("id", F.col("is_suspicious").alias("s")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_flag_reasons_lists_each_rule(spark):
    df = spark.createDataFrame([(2_000_000.0, "IRN", "SYR"), (1.0, "USA", "USA")],
                               "amount_usd double, sender_country string, receiver_country string")
    got = [r.flag_reasons for r in rules.flag_reasons(df).collect()]
    assert got[0] == ["HIGH_AMOUNT", "SANCTIONED_SENDER_COUNTRY", "SANCTIONED_RECEIVER_COUNTRY"]
    assert got[1] == []


def test_fee_rule_rounds_half_up_in_decimal(spark):
    df = spark.createDataFrame([(100.5,), (10_000.0,), (0.0,)], "a double")
    got = [float(r.f) for r in df.select(expected_fee("a").alias("f")).collect()]
    assert got == [6.01, 50.0, 5.0]


# ------------------------------------------------------------------ decode / flatten / validate
def test_malformed_message_is_quarantined_or_fails_fast(spark):
    msgs = spark.createDataFrame([("a", '{"transaction_id": "x", "amount_usd": 5}'), ("b", "{not json")],
                                 "key string, value string")
    out = {r.transaction_id: r.decode_error for r in decode_events(msgs).collect()}
    assert out == {"x": None, None: "{not json"}
    assert decode_events(msgs, mode="drop").count() == 1
    with pytest.raises(Exception):
        decode_events(msgs, mode="failfast").collect()


def test_json_value_semantics(spark):
    long_text = "x" * 4001
    rows = [('{"name": "Ann"}',), ('{"name": {"first": "A"}}',), ('{"name": [1]}',), ('{"name": null}',),
            ('{"other": 1}',), ("not json",), (f'{{"name": "{long_text}"}}',), ('{"name": 12.5}',)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.v for r in df.select(json_scalar("s", "$.name").alias("v")).collect()]
    assert got == ["Ann", None, None, None, None, None, long_text, "12.5"]


def test_timestamp_with_and_without_fraction(spark):
    msgs = spark.createDataFrame(
        [('{"transaction_id":"1","timestamp":"2024-01-01T10:00:00"}',),
         ('{"transaction_id":"2","timestamp":"2024-01-01T10:00:00.250000"}',)], "value string")
    p = project_stream(decode_events(msgs, ingest_col=None)).orderBy("transaction_id").collect()
    assert p[0].transactiondate == dt.datetime(2024, 1, 1, 10, 0, 0)
    assert p[1].transactiondate == dt.datetime(2024, 1, 1, 10, 0, 0, 250000)


def test_flatten_reads_text_and_struct_alike(spark):
    msgs = spark.createDataFrame([('{"transaction_id":"1","timestamp":"2024-01-01T00:00:00",'
                                   '"sender":{"name":"A","swift_code":"S1"},"metadata":{"channel":"WEB"}}',)], "value string")
    d = decode_events(msgs, ingest_col=None)
    as_text = flatten(project_stream(d)).collect()[0]
    as_struct = flatten(project_stream(d, nested_as_text=False)).collect()[0]
    for row in (as_text, as_struct):
        assert (row.sender_name, row.sender_swift_code, row.channel, row.receiver_name) == ("A", "S1", "WEB", None)


def test_validate_flags_nulls_and_overlong_text(spark):
    df = spark.createDataFrame([("1", "x" * 11, dt.datetime(2024, 1, 1)), (None, "ok", None)],
                               "transaction_id string, sender_country string, transactiondate timestamp")
    got = [r.reject_reasons for r in validate(df, not_null=["transaction_id", "transactiondate"]).collect()]
    assert got[0] == ["too_long:sender_country"]
    assert got[1] == ["null:transaction_id", "null:transactiondate"]


# ------------------------------------------------------------------ alert path
def test_safe_person_kinds(spark):
    df = spark.createDataFrame([("N/A",), ("",), (None,), ("plain name",), ('{"name": "Bo", "bank_name": "B"}',),
                                ("[1, 2]",), ('{"bank_name": "B"}',)], "p string")
    got = [(r.p.kind, r.p.name, r.p.bank_name) for r in df.select(safe_person("p").alias("p")).collect()]
    assert got == [("na", "N/A", "N/A"), ("na", "N/A", "N/A"), ("na", "N/A", "N/A"),
                   ("fallback", "plain name", "N/A"), ("object", "Bo", "B"), ("other", "N/A", "N/A"),
                   ("object", "N/A", "B")]


def test_safe_amount_non_numeric_is_zero(spark):
    df = spark.createDataFrame([("12.5",), ("abc",), (None,), (" 7 ",)], "a string")
    assert [r.v for r in df.select(safe_amount("a").alias("v")).collect()] == [12.5, 0.0, 0.0, 7.0]


def test_alert_details_only_above_threshold(spark):
    person = '{"name": "Ann", "bank_name": "B1", "swift_code": "S1", "account_number": "9"}'
    df = spark.createDataFrame([("a", "1000000", person), ("b", "1000000.01", person)],
                               "transaction_id string, amount_usd string, sender string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in
                         ["receiver", "fee_usd", "sender_country", "receiver_country", "transaction_type",
                          "status", "timestamp"]}).withColumn("source_file", F.lit("f.csv"))
    m = {r.transaction_id: r.message for r in alert_messages(df).collect()}
    assert "*Bank:*" not in m["a"] and "$1,000,000.00 USD" in m["a"]
    assert "• *Bank:* B1\n• *SWIFT:* S1\n• *Account:* 9\n• *Country:* N/A" in m["b"]
    assert "• *Name:* N/A\n• *Country:* N/A" in m["b"]  # receiver missing: no detail lines


def test_format_usd(spark):
    df = spark.createDataFrame([(1234.5,), (-0.5,)], "x double")
    assert [r.s for r in df.select(format_usd("x").alias("s")).collect()] == ["$1,234.50", "$-0.50"]


def test_csv_round_trip_keeps_newlines_quotes_commas(spark):
    addr = 'Line 1,\n"Suite" 2'
    df = spark.createDataFrame([("1", "2024-01-05T01:02:03", f'{{"name": "A", "address": {addr!r}}}', 5.0)],
                               "transaction_id string, timestamp string, sender string, amount_usd double")
    df = df.withColumns({"sender_country": F.lit("PRK"), "receiver_country": F.lit(None).cast("string")})
    base = scratch_path(spark, "csv-test")
    sk.write_routed(df, base, partition_by="event")
    schema_cols = ["transaction_id", "timestamp", "sender", "amount_usd", "sender_country", "receiver_country",
                   "flag_reasons"]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in schema_cols])
    back = fs.read_suspicious(spark, base, schema=schema).collect()
    assert len(back) == 1 and back[0].sender == df.collect()[0].sender
    assert (back[0].year, back[0].month, back[0].day, back[0].route) == ("2024", "01", "05", "suspicious")


# ------------------------------------------------------------------ dedup / top-k / branching
def test_dedup_keeps_earliest_processing_time(spark):
    df = spark.createDataFrame([("t1", dt.datetime(2024, 1, 2), "late"), ("t1", dt.datetime(2024, 1, 1), "early"),
                                ("t2", dt.datetime(2024, 1, 1), "only")], "id string, ts timestamp, v string")
    got = {r.id: (r.v, r.n_copies) for r in rec.dedup_earliest(df, "id", "ts", ["v"]).collect()}
    assert got == {"t1": ("early", 2), "t2": ("only", 1)}


def test_top_n_ties_are_broken_by_the_tie_column(spark):
    df = spark.createDataFrame([(3, 5.0), (1, 7.0), (0, 5.0), (2, 5.0), (4, 1.0), (5, None)], "id int, v double")
    assert [r.id for r in topk.top_n(df, 3, "v", "id").collect()] == [1, 0, 2]
    assert [r.id for r in topk.top_n(df, 6, "v", "id").collect()][-1] == 5  # NULL last, kept when n allows
    with pytest.raises(ValueError):
        topk.top_n(df, 3, "v", None)


@pytest.mark.parametrize("n_names,chart", [(9, "pie"), (10, "hbar")])
def test_pie_switches_to_bar_at_ten_names(spark, n_names, chart):
    df = spark.createDataFrame([(f"n{i}", float(i + 1), i) for i in range(n_names)], "name string, v double, id int")
    kinds = {r.chart for r in agg.pie_data(df, "name", "v", 10, tie="id").collect()}
    assert kinds == {chart}


def test_pie_counts_null_as_a_name(spark):
    rows = [(f"n{i}", 1.0, i) for i in range(9)] + [(None, 1.0, 9)]
    df = spark.createDataFrame(rows, "name string, v double, id int")
    assert {r.chart for r in agg.pie_data(df, "name", "v", 10, tie="id").collect()} == {"hbar"}


@pytest.mark.parametrize("n_x,rows_used", [(20, 40), (21, 20)])
def test_bar_uses_top_rows_above_twenty_categories(spark, n_x, rows_used):
    df = spark.createDataFrame([(f"x{i % n_x}", float(i), i) for i in range(40)], "x string, y double, id int")
    out = agg.bar_mean_data(df, "x", "y", 20, tie="id").collect()
    assert sum(r.n_rows for r in out) == rows_used
    assert all(r.showing_only == (n_x > 20) for r in out)


def test_histogram_max_value_in_last_bin_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    got = {r.bin: r["count"] for r in dist.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_corr_matrix_unknown_exclude_is_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9)], "a double, b double")
    assert dist.corr_matrix(df, exclude=["nope"]).count() == 0
    got = {(r.col_a, r.col_b): r.corr for r in dist.corr_matrix(df).collect()}
    assert math.isclose(got[("a", "b")], np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1], rel_tol=1e-9)


# ------------------------------------------------------------------ skew-safe helpers vs plain windows
def _hot_frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        rows.append((i, key, ts, rnd.randrange(1, 1000)))
    return spark.createDataFrame(rows, "id int, k string, ts timestamp, v long")


def test_running_sum_equals_window(spark):
    df = _hot_frame(spark)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = {r.id: r.c for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    got = {r.id: r.c for r in running_sum(df, ["k"], ["ts", "id"], "v", "c").collect()}
    assert got == ref


def test_previous_value_equals_lag(spark):
    df = _hot_frame(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = {r.id: r.p for r in df.select("id", F.lag("ts").over(w).alias("p")).collect()}
    got = {r.id: r.p for r in previous_value(df, ["k"], ["ts", "id"], "ts", "p").collect()}
    assert got == ref


def test_exact_quantiles_equal_pandas(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["g1", "g2", None]), float(rnd.randrange(0, 500)) / 4) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, y double")
    pdf = pd.DataFrame(rows, columns=["g", "y"])
    got = {(r.g, r.q): r.quantile for r in dist.exact_quantiles(df, "g", "y", (0.1, 0.25, 0.5, 0.9)).collect()}
    for g, sub in pdf.groupby("g", dropna=False):
        for q in (0.1, 0.25, 0.5, 0.9):
            key = None if isinstance(g, float) and math.isnan(g) else g
            assert math.isclose(got[(key, q)], sub["y"].quantile(q), rel_tol=1e-12, abs_tol=1e-9)


def test_kde_equals_direct_sum(spark):
    rnd = random.Random(5)
    xs = [rnd.gauss(10, 3) for _ in range(500)] + [5.0] * 50
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = sorted(dist.kde(df, "x", grid=50, bins=None).collect(), key=lambda r: r.grid_index)
    a = np.array(xs)
    bw = a.std(ddof=1) * len(a) ** -0.2
    for r in out[::7]:
        ref = np.exp(-0.5 * ((r.x - a) / bw) ** 2).sum() / (len(a) * bw * math.sqrt(2 * math.pi))
        assert math.isclose(r.density, ref, rel_tol=1e-9)


def test_sunburst_levels_sum_up(spark):
    df = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("B", "x", 4)], "p1 string, p2 string, v long")
    got = {r.node_id: (r.value, r.parent_id, r.depth) for r in hier.sunburst(df, ["p1", "p2"], "v").collect()}
    assert got == {"A": (3, "", 1), "B": (4, "", 1), "A/x": (1, "A", 2), "A/y": (2, "A", 2), "B/x": (4, "B", 2)}


def test_reconcile_statuses(spark):
    src = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    landed = spark.createDataFrame([("a",), ("a",), ("c",), ("d",)], "id string")
    got = {r.id: r.status for r in rec.reconcile(src, landed, "id").collect()}
    assert got == {"a": "duplicated", "b": "missing", "c": "matched", "d": "extra"}


def test_plain_date_folder_layout_is_read_with_dates_from_the_path(spark):
    import os
    base = scratch_path(spark, "plain")
    local = base[len("file:"):] if base.startswith("file:") else base
    rows = {"2024/01/05": "1,5.0\n2,7.5\n", "2024/02/11": "3,1.0\n"}
    for folder, body in rows.items():
        os.makedirs(f"{local}/{folder}", exist_ok=True)
        with open(f"{local}/{folder}/transactions_x.csv", "w") as f:
            f.write("transaction_id,amount_usd\n" + body)
    open(f"{local}/2024/02/11/empty.csv", "w").close()
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("amount_usd", T.StringType())])
    got = sorted((r.transaction_id, r.year, r.month, r.day, r.source_file.endswith("transactions_x.csv"))
                 for r in fs.read_suspicious(spark, base, layout="plain", schema=schema).collect())
    assert got == [("1", "2024", "01", "05", True), ("2", "2024", "01", "05", True), ("3", "2024", "02", "11", True)]


def test_dormancy_state_step_orders_ties_ignores_late_rows_and_carries_state():
    import pandas as pd

    from txmon.streaming.dormancy import Dormancy, first_and_last

    class State:
        v = None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Handle:
        def getValueState(self, name, schema):
            self.state = State()
            return self.state

    hour = 3_600_000_000
    step, handle = Dormancy(hour, 10.0, None), Handle()
    step.init(handle)

    def rows(ids, hours, amounts):
        ts = [int(h * hour) for h in hours]
        return first_and_last(pd.DataFrame({"account": "acct", "segment": [t // hour for t in ts], "id": ids, "ts": ts, "amount": amounts, "last_ts": ts}))

    b1 = rows(["b", "a", "c"], [0, 0, 2], [50.0, 50.0, None])
    assert list(step.handleInputRows(("acct",), iter([b1]), None)) == []  # no previous time; NULL amount never flags
    assert handle.state.v == (2 * hour,)
    b2 = rows(["late", "d", "e"], [0, 5, 5], [99.0, 20.0, 20.0])
    out = pd.concat(list(step.handleInputRows(("acct",), iter([b2.iloc[:1], b2.iloc[1:], b2.iloc[:0]]), None)))
    assert list(out["id"]) == ["d"]  # 'late' predates the state; 'e' follows 'd' with no gap
    assert (out["ts"] - out["prev_ts"]).iloc[0] == 3 * hour and out["account"].iloc[0] == "acct"


def test_segmented_windows_are_exact_for_one_hot_key_within_one_day(spark):
    import datetime as dt

    from pyspark.sql import Window

    from txmon.operators.segmented import previous_value, running_sum

    t0 = dt.datetime(2024, 3, 1)
    rows = [("hot", f"id{i:04d}", t0 + dt.timedelta(seconds=(i * 7919) % 86400), float(i % 13)) for i in range(600)]
    rows += [("cold", f"c{i}", t0 + dt.timedelta(hours=i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, id string, ts timestamp, v double")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {r.id: (r.cum, r.prev) for r in df.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.lag("ts").over(w).alias("prev")).collect()}
    cum = {r.id: r.cum for r in running_sum(df, ["k"], ["ts", "id"], "v", "cum").collect()}
    prev = {r.id: r.prev for r in previous_value(df, ["k"], ["ts", "id"], "ts", "prev").collect()}
    assert {i: (cum[i], prev[i]) for i in want} == want
    assert len({r.ts.hour for r in df.filter("k = 'hot'").select("ts").collect()}) == 24  # many segments
