"""Plan shape checks: pushdown, pruning, no Python in batch plans, partial aggregation,
hot keys split across tasks."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txmon.operators import reconcile as rec
from txmon.operators import topk
from txmon.plans import fixtures as fx
from txmon.plans.registry import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_queries_use_no_python_udfs(spark):
    for name, fn in QUERIES.items():
        if name.startswith(("t", "s3", "s4", "s6", "s7", "s8", "a24", "g3")):
            continue  # streams / writes run while being built
        p = plan(fn(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_filters_and_columns_reach_the_scan(spark):
    o = fx.table(spark, SF_SMALL, "orders")
    df = o.filter(F.col("o_totalprice") > 1000).select("o_orderkey")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_top_n_per_group_limits_before_the_shuffle(spark):
    t = fx.txn(spark, SF_SMALL)
    p = plan(topk.top_n_per_group(t, "transaction_type", 3, "amount_usd", "transaction_id"))
    assert "WindowGroupLimit" in p


def test_dedup_aggregates_partially_before_the_shuffle(spark):
    p = plan(rec.dedup_earliest(fx.transfers(spark, SF_SMALL), "id", "ts", ["amount"]))
    assert "partial_min_by" in p


def test_lag_windows_split_keys_into_segments(spark):
    p = plan(QUERIES["f6_flag_dormant"](spark, SF_SMALL))
    assert "_seg" in p and "Window [lag(" in p
