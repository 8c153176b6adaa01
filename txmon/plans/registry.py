"""Registered queries: one per operator of SURVEY section 2, each ``(spark, sf_dir) -> DataFrame``.

Each query runs the public operator over whole test tables (or views Spark derives from them).
Outputs cast DECIMAL to DOUBLE at the very end only, so results compare by value with the SQL
oracle; the operators themselves keep money in DECIMAL(18,2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.functions.jsonpath import node_scalar
from txmon.functions.money import expected_fee as fee_expr
from txmon.operators import aggregates as agg
from txmon.operators import flatten as fl
from txmon.operators import rules
from txmon.operators import topk
from txmon.plans import fixtures as fx
from txmon.plans.params import (DORMANT_GAP_SECONDS, DORMANT_MIN_AMOUNT, EVENT_RULES,
                                TXN_RULES)
from txmon.session import scratch_path
from txmon.sources.events import decode_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def doubles(df: DataFrame) -> DataFrame:
    """Presentation cast: DECIMAL -> DOUBLE (exact decimal -> nearest double)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


def rounded(df: DataFrame, cols, places: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


def events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw JSON messages -> decode (S2) -> projection (P1) -> flatten (P2) -> conform."""
    decoded = decode_events(fx.raw_events(spark, sf_dir))
    return fl.conform_flat(fl.flatten(fl.project_stream(decoded, nested_as_text=False)))


# ---------------------------------------------------------------- flagship / minimum slice
@register("a2_summarize_events")
def q_summarize_events(spark, sf):
    flagged = rules.flag_suspicious(events_flat(spark, sf), EVENT_RULES)
    return doubles(agg.summarize(flagged, "transaction_type", fee=None, flag="is_suspicious"))


# ---------------------------------------------------------------- decode, flatten, validate
@register("s2_decode_events")
def q_decode(spark, sf):
    d = decode_events(fx.events_to_faulty_messages(fx.table(spark, sf, "events")))
    return d.select("transaction_id", "timestamp", node_scalar(F.col("sender.name")).alias("sender_name"),
                    "amount_usd", "sender_country", "receiver_country", "transaction_type",
                    node_scalar(F.col("metadata.device_id")).alias("device_id"),
                    F.col("decode_error").isNotNull().alias("is_corrupt"), F.col("decode_error"))


@register("p1_project_stream")
def q_project(spark, sf):
    return fl.project_stream(decode_events(fx.raw_events(spark, sf)))


@register("p2_flatten")
def q_flatten(spark, sf):
    return fl.flatten(fl.project_stream(decode_events(fx.raw_events(spark, sf))))


@register("p3_conform_flat")
def q_conform(spark, sf):
    return doubles(events_flat(spark, sf))


@register("v1_validate")
def q_validate(spark, sf):
    # the table's own limits; every 19th address and every 23rd country name is too long, nine rows in ten pass
    key = F.col("transaction_id").cast("long")
    long = {"sender_address": F.when(key % 19 == 0, F.rpad("sender_address", 300, " x")).otherwise(F.col("sender_address")),
            "receiver_country": F.when(key % 23 == 0, F.concat("receiver_country", F.lit(" (formerly)"))).otherwise(F.col("receiver_country"))}
    bad = fl.validate(fx.txn(spark, sf).withColumns(long)).filter(F.size("reject_reasons") > 0)
    return bad.select("transaction_id", F.array_join("reject_reasons", ",").alias("reasons"))


@register("v1_validate_not_null")
def q_validate_nn(spark, sf):
    # every 97th message carries a timestamp that does not parse: P3 makes it NULL, V1 rejects it
    msgs = fx.raw_events(spark, sf)
    bad_ts = F.regexp_replace("value", r'"timestamp":"[^"]*"', '"timestamp":"not-a-time"')
    msgs = msgs.withColumn("value", F.when(F.col("key").cast("long") % 97 == 0, bad_ts).otherwise(F.col("value")))
    flat = fl.conform_flat(fl.flatten(fl.project_stream(decode_events(msgs), nested_as_text=False)))
    _, bad = fl.split_valid(flat)
    return bad.select("transaction_id", F.array_join("reject_reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- rules
@register("f1_is_high_amount")
def q_f1(spark, sf):
    return fx.txn(spark, sf).select("transaction_id", rules.is_high_amount(TXN_RULES.high_amount).alias("is_high_amount"))


@register("f2_is_sanctioned")
def q_f2(spark, sf):
    return fx.txn(spark, sf).select("transaction_id", rules.is_sanctioned(TXN_RULES.sanctioned).alias("is_sanctioned"))


@register("f3_flag_suspicious")
def q_f3(spark, sf):
    return rules.flag_suspicious(fx.txn(spark, sf), TXN_RULES).select("transaction_id", "is_suspicious")


@register("f4_flag_reasons")
def q_f4(spark, sf):
    r = rules.flag_reasons(fx.txn(spark, sf), TXN_RULES)
    return r.select("transaction_id", F.array_join("flag_reasons", ",").alias("reasons"))


@register("f5_route")
def q_f5(spark, sf):
    return rules.route(fx.txn(spark, sf), TXN_RULES).groupBy("route", "transaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_usd").cast("double").alias("total_amount"))


@register("f6_flag_dormant")
def q_f6(spark, sf):
    d = rules.flag_dormant(fx.txn(spark, sf), "sender_account_number", "transactiondate",
                           "amount_usd", "transaction_id", DORMANT_GAP_SECONDS, DORMANT_MIN_AMOUNT)
    return d.filter("is_dormant_burst").select("transaction_id", "sender_account_number",
                                              "prev_ts", "gap_seconds")


@register("f7_expected_fee")
def q_f7(spark, sf):
    ev = fx.table(spark, sf, "events")
    return doubles(ev.select(F.col("event_id"), fee_expr(F.col("value")).alias("expected_fee")))


@register("f8_fee_audit")
def q_f8(spark, sf):
    t = fx.transfers(spark, sf)
    charged = F.round(F.lit(5).cast("decimal(3,0)") + F.col("amount").cast("decimal(18,2)") * F.lit(0.01).cast("decimal(3,2)"), 2)
    a = rules.fee_audit(t.withColumn("fee", charged), amount_col="amount", fee_col="fee")
    return doubles(a.select("id", "l_orderkey", "l_linenumber", "amount", "fee", "expected_fee", "fee_diff"))


@register("j1_sanction_table")
def q_j1(spark, sf):
    nation = fx.table(spark, sf, "nation")
    listed = nation.filter(F.col("n_regionkey") == 2).select(F.col("n_name").alias("country"))
    m = rules.mark_sanctioned_by_table(fx.txn(spark, sf), listed)
    return m.select("transaction_id", "sanctioned_sender", "sanctioned_receiver", "is_sanctioned")


# ---------------------------------------------------------------- top-k
@register("l1_preview")
def q_l1(spark, sf):
    return doubles(topk.preview(fx.txn(spark, sf), 1000, order="transaction_id")
                   .select("transaction_id", "transactiondate", "sender_name", "amount_usd", "channel"))


@register("l2_bounded_sample")
def q_l2(spark, sf):
    t = fx.txn(spark, sf).select("transaction_id", "amount_usd", "transaction_type")
    s = topk.bounded_sample(t, 50, [F.col("amount_usd").desc(), F.col("transaction_id")])
    return doubles(s)


@register("l3_top_n")
def q_l3(spark, sf):
    return doubles(topk.top_n(fx.txn(spark, sf), 10, "amount_usd", "transaction_id")
                   .select("transaction_id", "sender_name", "amount_usd"))


@register("l4_latest")
def q_l4(spark, sf):
    return doubles(topk.latest(fx.txn(spark, sf), "transactiondate", "transaction_id", 5)
                   .select("transaction_id", "transactiondate", "amount_usd"))


@register("l5_limit_categories")
def q_l5(spark, sf):
    t = fx.txn(spark, sf).select("transaction_id", "sender_country", "amount_usd")
    return doubles(topk.limit_categories(t, "sender_country", "amount_usd", 10, 10, tie="transaction_id"))


@register("l5_limit_categories_bar")
def q_l5b(spark, sf):
    # the bar rule: more than 20 distinct values, NULL not counted
    t = fx.txn(spark, sf).select("transaction_id", "sender_country", "amount_usd")
    return doubles(topk.limit_categories(t, "sender_country", "amount_usd", 25, 20, tie="transaction_id", at_most=True))


@register("w4_top_n_per_group")
def q_w4(spark, sf):
    t = fx.txn(spark, sf)
    r = topk.top_n_per_group(t, "transaction_type", 3, "amount_usd", "transaction_id")
    return doubles(r.select("transaction_type", "rank", "transaction_id", "amount_usd"))


# ---------------------------------------------------------------- aggregates
@register("a1_row_count")
def q_a1(spark, sf):
    return agg.row_count(fx.txn(spark, sf))


@register("a2_summarize")
def q_a2(spark, sf):
    f = rules.flag_suspicious(fx.txn(spark, sf), TXN_RULES)
    return doubles(agg.summarize(f, "transaction_type", flag="is_suspicious"))


@register("a3_radar_data")
def q_a3(spark, sf):
    return doubles(agg.radar_data(fx.txn(spark, sf), "channel", "amount_usd", "total_amount"))


@register("a4_bar_data")
def q_a4(spark, sf):
    return agg.bar_data(fx.table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "sum_qty")


@register("a5_bar_mean_data")
def q_a5(spark, sf):
    t = fx.txn(spark, sf)
    return doubles(agg.bar_mean_data(t, "sender_country", "amount_usd", 20, tie="transaction_id"))


@register("a5_bar_mean_data_few")
def q_a5b(spark, sf):
    t = fx.txn(spark, sf)
    return doubles(agg.bar_mean_data(t, "transaction_type", "amount_usd", 20, tie="transaction_id"))


@register("a6_pie_data")
def q_a6(spark, sf):
    return doubles(agg.pie_data(fx.txn(spark, sf), "transaction_type", "amount_usd", 10))


@register("a6_pie_data_many")
def q_a6b(spark, sf):
    return doubles(agg.pie_data(fx.txn(spark, sf), "receiver_country", "amount_usd", 10, tie="transaction_id"))


@register("a7_hbar_data")
def q_a7(spark, sf):
    return doubles(agg.hbar_data(fx.txn(spark, sf), "amount_usd", "sender_name", 10, tie="transaction_id"))


@register("a8_value_counts")
def q_a8(spark, sf):
    return agg.value_counts(fx.txn(spark, sf), "status")


@register("a9_line_mean_data")
def q_a9(spark, sf):
    t = fx.txn(spark, sf).withColumn("order_year", F.year("transactiondate"))
    return rounded(agg.line_mean_data(t, "order_year", "amount_usd"), ["mean", "sd", "ci_low", "ci_high"])


@register("a9_line_mean_bootstrap")
def q_a9_bootstrap(spark, sf):
    t = fx.txn(spark, sf).withColumn("order_year", F.year("transactiondate"))
    return rounded(agg.line_mean_bootstrap(t, "order_year", "amount_usd", "transaction_id"), ["mean", "ci_low", "ci_high"])


@register("a23_stored_distinct")
def q_a23_stored(spark, sf):
    # three loads, each reduced to sketches; the estimate must lie within 3 % of the exact number
    path, t = scratch_path(spark, "distinct"), fx.txn(spark, sf)
    columns = ["transaction_id", "sender_account_number", "sender_swift_code"]
    for k in range(3):
        agg.store_distinct(t.filter(F.col("transaction_id").cast("long") % 3 == k), columns, path, f"l{k}")
    exact = t.agg(*[F.count_distinct(c).alias(c) for c in columns]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in columns])).alias("e")).select("e.*")
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return agg.stored_distinct(spark, path).join(exact, "column_name").select("column_name", "n_loads", "n_rows", "exact", near.alias("near"))


@register("a23_distinct_count")
def q_a23(spark, sf):
    return agg.distinct_count(fx.txn(spark, sf), "sender_account_number")


@register("a25_corridors")
def q_a25(spark, sf):
    f = rules.flag_suspicious(fx.txn(spark, sf), TXN_RULES)
    return doubles(agg.corridors(f, flag="is_suspicious"))


# ---------------------------------------------------------------- distributions
from txmon.operators import distribution as dist  # noqa: E402
from txmon.operators import hierarchy as hier  # noqa: E402
from txmon.operators import reconcile as rec  # noqa: E402
from txmon.operators import text as txt  # noqa: E402
from txmon.operators import windows as win  # noqa: E402


@register("a10_points")
def q_a10(spark, sf):
    return doubles(dist.points(fx.txn(spark, sf), ["transaction_id", "transactiondate", "amount_usd"]))


@register("a11_histogram")
def q_a11(spark, sf):
    return rounded(dist.histogram(fx.table(spark, sf, "events"), "value", 10), ["bin_lo", "bin_hi"], 6)


@register("a11_histogram_amount")
def q_a11b(spark, sf):
    return rounded(dist.histogram(fx.txn(spark, sf), "amount_usd", 20), ["bin_lo", "bin_hi"], 6)


@register("a12_density_heatmap")
def q_a12(spark, sf):
    return dist.density_heatmap(fx.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10, 12)


@register("a13_box_stats")
def q_a13(spark, sf):
    b = dist.box_stats(fx.txn(spark, sf), "transaction_type", "amount_usd")
    return rounded(b, ["q1", "median", "q3", "iqr", "min", "max"], 4)


@register("a13_box_stats_skewed")
def q_a13s(spark, sf):
    # one group holds every row: the exact path must still split it across tasks
    li = fx.table(spark, sf, "lineitem").withColumn("grp", F.when(F.col("l_linenumber") > 0, F.lit("all")))
    b = dist.box_stats(li, "grp", "l_extendedprice")
    return rounded(b, ["q1", "median", "q3", "iqr", "min", "max"], 4)


@register("a14_violin_stats")
def q_a14(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    v = dist.violin_stats(li, "l_returnflag", "price", color="l_linestatus")
    return rounded(v, ["mean", "q1", "median", "q3"], 4)


def _curve(k, *by):
    return k.select(*by, "grid_index", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 4).alias("density_e6"))


@register("a14_violin_grid")
def q_a14g(spark, sf):
    return _curve(dist.violin_grid(fx.table(spark, sf, "events"), "event_type", "value", grid=50, bins=None), "event_type")


@register("a15_kde_columns")
def q_a15c(spark, sf):
    return _curve(dist.kde_columns(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], grid=100, bins=None), "series")


@register("a15_density_histogram")
def q_a15h(spark, sf):
    return rounded(dist.density_histogram(fx.table(spark, sf, "events"), "value", 10), ["bin_lo", "bin_hi", "density"], 6)


@register("a15_kde")
def q_a15(spark, sf):
    return _curve(dist.kde(fx.table(spark, sf, "events"), "value", by="event_type", grid=200, bins=None), "event_type")


@register("a15_kde_binned")
def q_a15b(spark, sf):
    return _curve(dist.kde(fx.table(spark, sf, "events"), "value", grid=200))


@register("a16_corr_matrix")
def q_a16(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    c = dist.corr_matrix(li, exclude=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return rounded(c, ["corr"], 6)


@register("a17_pivot_heatmap")
def q_a17(spark, sf):
    t = fx.txn(spark, sf)
    return rounded(dist.pivot_heatmap(t, "sender_country", "transaction_type", "amount_usd", 10, tie="transaction_id"),
                   ["value"], 4)


def _customer_geo(spark, sf):
    c = fx.table(spark, sf, "customer")
    n = fx.table(spark, sf, "nation")
    r = fx.table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select("r_name", "n_name", "c_mktsegment", "c_custkey",
                     F.col("c_acctbal").cast("decimal(18,2)").alias("acctbal")))


@register("a18_sunburst")
def q_a18(spark, sf):
    return doubles(hier.sunburst(_customer_geo(spark, sf), ["r_name", "n_name", "c_mktsegment"], "acctbal"))


@register("a19_treemap")
def q_a19(spark, sf):
    p = fx.table(spark, sf, "part")
    t = hier.treemap(p, ["p_type", "p_brand"], "p_size", "p_retailprice")
    return rounded(t, ["color"], 6)


@register("a20_funnel")
def q_a20(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("amount", F.col("value").cast("decimal(18,2)"))
    return rounded(doubles(hier.funnel(ev, "event_type", "amount")), ["share_of_first"], 6)


@register("a21_choropleth")
def q_a21(spark, sf):
    return doubles(hier.choropleth(fx.txn(spark, sf), "receiver_country", "amount_usd", "sender_name"))


@register("a22_word_counts")
def q_a22(spark, sf):
    return txt.word_counts(fx.table(spark, sf, "documents"), "text", 200)


@register("w1_cumulative")
def q_w1(spark, sf):
    c = win.cumulative(fx.txn(spark, sf), "transaction_type", "amount_usd", ["transactiondate", "transaction_id"])
    return doubles(c.select("transaction_id", "transaction_type", "amount_usd", "cumulative_sum"))


@register("w2_activity_gap")
def q_w2(spark, sf):
    ev = fx.table(spark, sf, "events")
    g = win.activity_gap(ev, "user_id", "ts", "event_id")
    return g.select("event_id", "user_id", "prev_ts", "gap_seconds")


@register("w3_share_of_total")
def q_w3(spark, sf):
    s = agg.group_sum(fx.txn(spark, sf), "channel", "amount_usd", "total_amount")
    return rounded(doubles(win.share_of_total(s, "total_amount")), ["share"], 9)


@register("u1_union_routes")
def q_u1(spark, sf):
    s, n = rules.split_routes(fx.txn(spark, sf), TXN_RULES)
    u = rec.union_routes(s.drop("route"), n.drop("route").drop("channel"))
    return u.select("transaction_id", "route", "channel")


def _transfer_ties():
    return ["amount", "account", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"]


@register("u2_dedup_earliest")
def q_u2(spark, sf):
    d = rec.dedup_earliest(fx.transfers(spark, sf), "id", "ts", _transfer_ties())
    return d.select("id", "ts", "amount", "account", "l_partkey", "n_copies")


@register("u3_reconcile")
def q_u3(spark, sf):
    t = fx.transfers(spark, sf)
    landed = (t.filter(F.col("l_linenumber") != 3)
               .unionByName(t.filter(F.col("l_linenumber") == 1))
               .unionByName(t.filter(F.col("l_linenumber") == 2).withColumn("id", F.concat("id", F.lit("-x")))))
    return rec.reconcile(t, landed, "id")


# ---------------------------------------------------------------- sources, sinks, streams
from pyspark.sql import types as _T  # noqa: E402

from txmon.operators import alerts as al  # noqa: E402
from txmon.plans import charts  # noqa: E402
from txmon.plans import reports as rp  # noqa: E402
from txmon.plans.params import EVENT_DORMANT_GAP_SECONDS, EVENT_DORMANT_MIN_VALUE  # noqa: E402
from txmon.functions.safe import safe_amount, safe_person  # noqa: E402
from txmon.sources import compaction as cp  # noqa: E402
from txmon.sources import files as fs  # noqa: E402
from txmon.sources import sinks as sk  # noqa: E402
from txmon.sources.events import read_event_stream  # noqa: E402
from txmon.streaming import dormancy as dm  # noqa: E402
from txmon.streaming import monitor as pl  # noqa: E402
from txmon.streaming import sessions as ss  # noqa: E402
from txmon.streaming import windows as sw  # noqa: E402


def _events_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


# Multi-batch stream runs over the test tables: event-time slices of ``events``, each read as
# one micro-batch (see ``fixtures.stage_time_slices``).
SLICES, SLICE_FILES = 4, 8


def _sliced_events_stream(spark, sf, order=None):
    events = fx.table(spark, sf, "events")
    return read_slices(spark, events.schema, fx.stage_time_slices(events, "ts", scratch_path(spark, "staged-events"), SLICES, SLICE_FILES, order))


def read_slices(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", SLICE_FILES).option("recursiveFileLookup", "true").parquet(path)


def _messages(spark, sf, faulty=False):
    schema = fx.table(spark, sf, "events").schema
    return read_event_stream(spark, "parquet", convert=fx.events_to_faulty_messages if faulty else fx.events_to_messages,
                             path=sf, schema=schema, pathGlobFilter="events.parquet")


def _run_to_parquet(df, spark, name, mode="append"):
    out, ck = scratch_path(spark, name), scratch_path(spark, f"{name}-ck")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ck) \
          .trigger(availableNow=True).start()
    pl.run_available(q)
    return spark.read.parquet(out)


def _routed_events(spark, sf):
    base, ck = scratch_path(spark, "routed"), scratch_path(spark, "routed-ck")
    pl.run_available(pl.monitor_stream(_messages(spark, sf, faulty=True), base, ck, EVENT_RULES))
    return base


def _routed_view(spark, base):
    r = fs.read_routed(spark, base)
    return r.select("transaction_id", "route", "year", "month", "day",
                    F.col("amount_usd").cast("double").alias("amount_usd"), "flag_reasons",
                    F.col("decode_error").isNotNull().alias("is_corrupt"))


@register("t1_monitor_stream")
def q_t1(spark, sf):
    base, ck = scratch_path(spark, "routed"), scratch_path(spark, "routed-ck")
    messages = fx.events_to_faulty_messages(_sliced_events_stream(spark, sf))
    pl.run_available(pl.monitor_stream(messages, base, ck, EVENT_RULES))
    return _routed_view(spark, base)


@register("t3_run_available")
def q_t3(spark, sf):
    r = fs.read_routed(spark, _routed_events(spark, sf))
    return (r.groupBy("route", "year", "month")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.col("amount_usd").cast("decimal(18,2)")).cast("double").alias("total_amount")))


@register("a24_run_metrics")
def q_a24(spark, sf):
    # per file; file names are random, so the files' dates are compared (one or more files a date)
    r = fs.read_routed(spark, _routed_events(spark, sf))
    m = al.run_metrics(r, suspicious=F.col("route") == "suspicious")
    day = F.regexp_extract("source_file", r"route=([a-z]+)/year=(\d+)/month=(\d+)/day=(\d+)/[^/]+$", 0)
    day = F.regexp_replace(F.regexp_replace(day, r"/[^/]+$", ""), r"(route|year|month|day)=", "")
    return m.groupBy(day.alias("folder")).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_errors", "n_processed", "n_suspicious", "n_normal")])


@register("t4_dormant_stream")
def q_t4(spark, sf):
    flagged = dm.dormant_stream(_sliced_events_stream(spark, sf), "user_id", "ts", "value", "event_id",
                                EVENT_DORMANT_GAP_SECONDS, EVENT_DORMANT_MIN_VALUE)
    return _run_to_parquet(flagged, spark, "dormant")


def _mask_path(col):
    plain = F.regexp_replace(col, r"\*File Path:\*\n[^\n]*\n", "*File Path:*\n<path>\n")
    return F.regexp_replace(plain, r"\nFile: [^\n]*\n", "\nFile: <path>\n")


@register("t5_alert_stream")
def q_t5(spark, sf):
    base = _routed_events(spark, sf)
    out, ck = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-ck")
    pl.run_available(pl.alert_stream(spark, base, out, ck))
    a = spark.read.parquet(out)
    return a.select("transaction_id", "route", "amount", "fee", "sender_name", "receiver_name",
                    _mask_path(F.col("message")).alias("message"))


@register("t5_alert_files")
def q_t5_files(spark, sf):
    # files from elsewhere, two a day: day 2 names the id otherwise, day 3 has other columns and order, day 4 no header
    base, out, ck = (scratch_path(spark, n) for n in ("suspicious-files", "alerts", "alerts-ck"))
    t = (fx.txn(spark, sf).withColumn("timestamp", F.date_format("transactiondate", "yyyy-MM-dd'T'HH:mm:ss"))
         .select("transaction_id", "timestamp", "amount_usd", "fee_usd", "sender_country", "receiver_country", "status"))
    day = F.col("transaction_id").cast("long") % 4
    for k, (shape, header) in enumerate([(t.columns, True), (["transaction_id AS id", *t.columns[1:]], True),
                                         (["status", "'x' AS note", "amount_usd", "transaction_id", "sender_country"], True), (t.columns, False)]):
        part = t.filter(day == k).repartition(2).selectExpr(*shape)
        part.write.option("header", header).csv(f"{base}/2024/01/{k + 1:02}")
    pl.run_available(pl.alert_stream(spark, base, out, ck, layout="plain"))
    return spark.read.parquet(out).select("transaction_id", "route", "amount", "fee", "sender_name", _mask_path(F.col("message")).alias("message"), "decode_error")


def _land_windows(spark, windows, keys):
    out, ck = scratch_path(spark, "windows"), scratch_path(spark, "windows-ck")
    pl.run_available(sw.land_windows(windows, out, ck))
    return sw.read_windows(spark, out, keys)


@register("t2_batch_sizing")
def q_t2(spark, sf):
    # maxFilesPerTrigger bounds each micro-batch: one time slice each
    out, ck = scratch_path(spark, "sized"), scratch_path(spark, "sized-ck")
    proj = fl.project_stream(decode_events(fx.events_to_messages(_sliced_events_stream(spark, sf))))
    pl.run_available(sk.sink_stream(proj, out, ck))
    return spark.read.parquet(out).groupBy(F.col("batch_id").cast("int").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("s9_resume")
def q_s9(spark, sf):
    # two bounded runs of one query over a growing folder: the second resumes after the first
    events = fx.table(spark, sf, "events")
    path, out, ck = (scratch_path(spark, n) for n in ("resume-in", "resume-out", "resume-ck"))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    early = t * 2 <= events.select(F.min(t) + F.max(t)).scalar()
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(path)
        stream = read_event_stream(spark, "parquet", convert=fx.events_to_messages, path=path, schema=events.schema)
        pl.run_available(sk.sink_stream(fl.project_stream(decode_events(stream)), out, ck))
    return spark.read.parquet(out).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_landed"), F.max(F.col("batch_id").cast("int")).alias("batch_id"))


@register("t10_late_data")
def q_t10(spark, sf):
    # the oldest slice arrives last: the watermark has passed it, its rows are dropped
    w = sw.windowed(_sliced_events_stream(spark, sf, order=[1, 2, 3, 0]), "ts", "15 minutes", by=["event_type"], watermark="1 hour")
    return _land_windows(spark, w, ["window_start", "window_end", "event_type"])


def _landed_and_late(spark, sf):
    # the oldest slice arrives last
    out, late, ck = (scratch_path(spark, n) for n in ("parts", "late", "late-ck"))
    ev = _sliced_events_stream(spark, sf, order=[1, 2, 3, 0])
    pl.run_available(sw.land_windows_and_late(ev, "ts", "15 minutes", ["event_type"], out, late, ck))
    return out, late


@register("t10_late_rows")
def q_t10_late(spark, sf):
    return spark.read.parquet(_landed_and_late(spark, sf)[1] + "/rows").drop("batch_id")


@register("t10_window_parts")
def q_t10_parts(spark, sf):
    return sw.read_window_parts(spark, _landed_and_late(spark, sf)[0], ["window_start", "window_end", "event_type"])


@register("t6_windowed")
def q_t6(spark, sf):
    ev = _events_stream(spark, sf).withColumn("amount", F.col("value").cast("decimal(18,2)"))
    w = sw.windowed(ev, "ts", "1 day", by=["event_type"], value="amount", watermark="1 hour")
    return doubles(_land_windows(spark, w, ["window_start", "window_end", "event_type"]))


@register("t6_compacted_windows")
def q_t6_compacted(spark, sf):
    # four micro-batches land; the first three are packed into one generation
    keys = ["window_start", "window_end", "event_type"]
    out, packed, ck = (scratch_path(spark, n) for n in ("windows", "windows-packed", "windows-ck"))
    ev = _sliced_events_stream(spark, sf).withColumn("amount", F.col("value").cast("decimal(18,2)"))
    pl.run_available(sw.land_windows(sw.windowed(ev, "ts", "1 day", by=["event_type"], value="amount"), out, ck))
    sw.compact_windows(spark, out, keys, packed)
    return doubles(sw.read_windows(spark, out, keys, packed))


@register("s3_compacted_routed")
def q_s3_compacted(spark, sf):
    # two generations and files that came after them
    events = fx.table(spark, sf, "events")
    src, base, packed, ck = (scratch_path(spark, n) for n in ("events", "routed", "routed-packed", "routed-ck"))
    for third in range(3):
        events.filter(F.col("event_id") % 3 == third).write.mode("append").parquet(src)
        messages = fx.events_to_faulty_messages(spark.readStream.schema(events.schema).parquet(src))
        pl.run_available(pl.monitor_stream(messages, base, ck, EVENT_RULES))
        if third < 2:
            cp.compact_routed(spark, base, packed)
    r = cp.read_routed_compacted(spark, base, packed)
    return r.select("transaction_id", "route", "year", "month", "day", F.col("amount_usd").cast("double").alias("amount_usd"), "flag_reasons",
                    F.col("decode_error").isNotNull().alias("is_corrupt"))


@register("t7_sliding_windows")
def q_t7(spark, sf):
    w = sw.windowed(_events_stream(spark, sf), "ts", "1 hour", by=["user_id"], slide="15 minutes", watermark="1 hour")
    return _land_windows(spark, w, ["window_start", "window_end", "user_id"])


@register("t8_sessions")
def q_t8(spark, sf):
    return ss.sessions(fx.table(spark, sf, "events"), "ts", "2 hours", "user_id")


@register("t8_session_stream")
def q_t8_stream(spark, sf):
    # four micro-batches: sessions that span two of them, and the ones still open at the end
    out, ck = scratch_path(spark, "sessions"), scratch_path(spark, "sessions-ck")
    events = _sliced_events_stream(spark, sf).withColumn("hundredths", F.round(F.col("value") * 100))
    pl.run_available(ss.land_sessions(events, "ts", "2 hours", "user_id", out, ck, value="hundredths"))
    return ss.read_sessions(spark, out, "user_id").drop("closed")


@register("t9_dedup_stream")
def q_t9(spark, sf):
    # re-delivered messages, dropped within a delay of 2 hours of event time
    messages = fx.redelivered(fx.events_to_messages(_sliced_events_stream(spark, sf)))
    d = sw.dedup_stream(decode_events(messages).withColumn("ts", F.col("timestamp").cast("timestamp")), "transaction_id", "ts", "2 hours")
    return _run_to_parquet(fl.project_stream(d), spark, "dedup")


@register("s6_sink_stream")
def q_s6(spark, sf):
    from txmon.sources.events import decode_events as _dec
    proj = fl.project_stream(_dec(_messages(spark, sf)))
    out, ck = scratch_path(spark, "sink"), scratch_path(spark, "sink-ck")
    pl.run_available(sk.sink_stream(proj, out, ck))
    return spark.read.parquet(out).drop("batch_id")


_TXN_ROUTED = ["transaction_id", "transactiondate", "amount_usd", "sender_country", "receiver_country"]


def _write_txn_routed(spark, sf):
    base = scratch_path(spark, "txn-routed")
    sk.write_routed(fx.txn(spark, sf).select(*_TXN_ROUTED), base, TXN_RULES, partition_by="event",
                    event_ts="transactiondate")
    schema = _T.StructType([_T.StructField(c, _T.StringType()) for c in _TXN_ROUTED + ["flag_reasons"]])
    return base, schema


@register("s3_write_routed")
def q_s3(spark, sf):
    base, schema = _write_txn_routed(spark, sf)
    r = fs.read_routed(spark, base, schema=schema)
    return r.select("transaction_id", "route", "year", "month", "day",
                    F.col("amount_usd").cast("double").alias("amount_usd"), "flag_reasons")


@register("s4_read_suspicious")
def q_s4(spark, sf):
    base, schema = _write_txn_routed(spark, sf)
    r = fs.read_suspicious(spark, base, schema=schema)
    return r.select("transaction_id", "route", "year", "month", "day",
                    F.col("source_file").endswith(".csv").alias("from_csv"))


def _flat_txn(spark, sf):
    return fl.conform_flat(fx.txn(spark, sf))


@register("s7_load_flat")
def q_s7(spark, sf):
    path = scratch_path(spark, "flat-append")
    flat = _flat_txn(spark, sf)
    sk.load_flat(flat, path, mode="append")
    sk.load_flat(flat, path, mode="append")
    return spark.read.parquet(path).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_copies"))


@register("s8_load_incremental")
def q_s8(spark, sf):
    path = scratch_path(spark, "flat-incremental")
    flat = _flat_txn(spark, sf)
    # the second load brings old keys again and every third new key twice, the later copy processed a day later
    again = flat.filter(F.col("transaction_id").cast("long") % 3 == 0).withColumn("processing_time", F.col("processing_time") + F.expr("INTERVAL 1 DAY"))
    sk.load_flat(flat.filter(F.col("status") == "F"), path, mode="incremental")
    sk.load_flat(flat.unionByName(again), path, mode="incremental")
    return spark.read.parquet(path).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_copies"), F.max("processing_time").alias("processing_time"))


@register("s8_load_by_period")
def q_s8_by_period(spark, sf):
    # as s8_load_incremental, into folders by month: some later copies come back under another one
    path = scratch_path(spark, "flat-by-month")
    flat = _flat_txn(spark, sf)
    again = flat.filter(F.col("transaction_id").cast("long") % 3 == 0).withColumn("processing_time", F.col("processing_time") + F.expr("INTERVAL 1 DAY"))
    sk.load_by_period(flat.filter(F.col("status") == "F"), path, period="yyyy-MM")
    sk.load_by_period(flat.unionByName(again), path, period="yyyy-MM")
    return spark.read.parquet(path).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n_copies"), F.max("processing_time").alias("processing_time"))


def _views(spark, sf):
    fx.register_tables(spark, sf, ["customer", "nation", "region"])
    fx.register_fixtures(spark, sf)


@register("s10_cached_sql")
def q_s10(spark, sf):
    _views(spark, sf)
    # first use, a hit, and a fresh answer after the view has been replaced
    sql = "SELECT channel, COUNT(*) AS n FROM txn GROUP BY channel"
    fs.uncache_sql(spark, sql)
    first = fs.cached_sql(spark, sql)
    second = fs.cached_sql(spark, sql)
    fx.txn(spark, sf).filter(F.col("status") == "F").createOrReplaceTempView("txn")
    fs.uncache_sql(spark, sql)
    third = fs.cached_sql(spark, sql)
    fx.txn(spark, sf).createOrReplaceTempView("txn")
    parts = [("first", first, False), ("second", second, second is first), ("replaced", third, third is first)]
    tagged = [d.select(F.lit(step).alias("step"), F.lit(hit).alias("hit"), "channel", "n") for step, d, hit in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@register("s5_read_table")
def q_s5(spark, sf):
    _views(spark, sf)
    return doubles(fs.read_table(spark, "txn"))


@register("g1_run_sql")
def q_g1(spark, sf):
    _views(spark, sf)
    return doubles(fs.run_sql(spark, """
        WITH big AS (SELECT sender_country, amount_usd FROM txn
                     WHERE amount_usd > (SELECT AVG(amount_usd) FROM txn))
        SELECT sender_country, COUNT(*) AS n_big, SUM(amount_usd) AS big_amount
        FROM big GROUP BY sender_country HAVING COUNT(*) > 10"""))


@register("g2_describe_table")
def q_g2(spark, sf):
    return rp.describe_table(fx.txn(spark, sf), exact_distinct=True)


@register("g2_describe_approx")
def q_g2_approx(spark, sf):
    # the default: one pass without expansion; what a reader takes from a distinct count is compared
    d = rp.describe_table(fx.txn(spark, sf))
    share = F.try_divide(F.col("distinct_count"), F.col("row_count"))
    kind = F.when(share >= 0.9, "unique").when(F.col("distinct_count") <= 10, "few").otherwise("some")
    return d.withColumn("kind", kind).drop("distinct_count")


_TOPICS = {
    "by_channel": "SELECT channel, COUNT(*) AS n FROM txn GROUP BY channel",
    "nothing_big": "SELECT * FROM txn WHERE amount_usd > 1000000000",
    "broken": "SELECT no_such_column FROM txn",
    "fails_later": "SELECT CAST(channel AS INT) AS n FROM txn",
}


@register("g3_run_reports")
def q_g3(spark, sf):
    _views(spark, sf)
    return rp.report_status(spark, rp.run_reports(spark, _TOPICS))


@register("g4_chart_data")
def q_g4(spark, sf):
    b = charts.chart_data(fx.txn(spark, sf), "box_plot", x_col="transaction_type", y_col="amount_usd")
    return rounded(b, ["q1", "median", "q3", "iqr", "min", "max"], 4)


@register("g4_chart_data_histogram")
def q_g4h(spark, sf):
    h = charts.chart_data(fx.table(spark, sf, "events"), "histogram", x_col="value", bins=10)
    return rounded(h, ["bin_lo", "bin_hi"], 6)


def _chart(name, kind, make, places=None, **kw):
    @register(f"g4_{name}")
    def q(spark, sf):
        out = doubles(charts.chart_data(make(spark, sf), kind, **kw))
        return rounded(out, places, 4) if places else out


_chart("area_points", "area_chart", fx.txn, x_col="transaction_id", y_col="amount_usd")
_chart("3d_scatter", "3D_scatter_plot", lambda s, d: fx.table(s, d, "lineitem"), x_col="l_quantity", y_col="l_extendedprice", z_col="l_discount", color_col="l_returnflag")
_chart("scatter_hue", "scatter_chart", fx.txn, x_col="transaction_id", y_col="amount_usd", hue_col="status")
_chart("bubble_hue", "bubble_chart", fx.txn, x_col="transaction_id", y_col="amount_usd", size_col="fee_usd", hue_col="channel")
_chart("histogram_col", "histogram", lambda s, d: fx.table(s, d, "events"), ["bin_lo", "bin_hi"], col="value", title="Values")
_chart("treemap_value_col", "treemap_chart", lambda s, d: fx.table(s, d, "part"), ["color"], path=["p_type", "p_brand"], value_col="p_size", color_col="p_retailprice")
_chart("radar", "radar_chart", fx.txn, unique_col="channel", aggregated_column="amount_usd", chart_name="Performance")
_chart("timeline", "timeline_chart", fx.txn, x_start="transactiondate", x_end="processing_time", y_col="transaction_id", color_col="status")
_chart("parallel", "parallel_coordinates", lambda s, d: fx.table(s, d, "lineitem"), dimensions=["l_quantity", "l_tax"], color_col="l_discount")


def _g5(name):
    def q(spark, sf):
        _views(spark, sf)
        out = rp.standard_reports(spark)[name]
        return rounded(doubles(out), ["avg_amount", "share"], 6)
    return q


for _name in rp.STANDARD_REPORTS:
    register(f"g5_{_name}")(_g5(_name))


# ---------------------------------------------------------------- P4-P6 on table-derived text
def _person_cells(spark, sf):
    c = fx.table(spark, sf, "customer")
    obj = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("account_number"),
                             F.concat(F.lit("BANK_"), F.col("c_nationkey").cast("string")).alias("bank_name")))
    k = F.col("c_custkey")
    cell = (F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.lit("N/A"))
             .when(k % 3 == 0, F.col("c_name")).when(k % 11 == 0, F.lit("[1, 2]")).otherwise(obj))
    amount = F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", cell.alias("sender"), amount.alias("amount_usd"))


@register("p4_safe_person")
def q_p4(spark, sf):
    p = _person_cells(spark, sf).withColumn("_p", safe_person("sender"))
    return p.select("c_custkey", F.col("_p.kind").alias("kind"), F.col("_p.name").alias("name"),
                    F.col("_p.bank_name").alias("bank_name"), F.col("_p.account_number").alias("account_number"))


@register("p5_safe_amount")
def q_p5(spark, sf):
    return _person_cells(spark, sf).select("c_custkey", safe_amount("amount_usd").alias("amount"))


@register("p6_alert_messages")
def q_p6(spark, sf):
    t = rules.flag_suspicious(fx.txn(spark, sf), TXN_RULES).filter("is_suspicious")
    cells = t.select(
        "transaction_id", F.date_format("transactiondate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.to_json(F.struct(F.col("sender_name").alias("name"), F.col("sender_account_number").alias("account_number"))).alias("sender"),
        F.lit(None).cast("string").alias("receiver"),
        F.col("amount_usd").cast("string").alias("amount_usd"), F.col("fee_usd").cast("string").alias("fee_usd"),
        "sender_country", "receiver_country", "transaction_type", "status", F.lit("txn").alias("source_file"))
    a = al.alert_messages(cells, detail_threshold=400000.0)
    return a.select("transaction_id", "amount", "fee", "sender_name", "receiver_name", "message")
