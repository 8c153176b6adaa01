"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is produced, nothing is
collected to the driver). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

What stands for the outside world is made before the clock starts: the messages of ``p2_flatten`` are stored as a bus
would deliver them, and the streams' input slices are staged. ``calibration_sec`` times a fixed plain-Python loop and a fixed
Spark aggregate of generated numbers, so that rounds on different machines can be compared.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txmon.plans.registry import QUERIES  # noqa: E402
from txmon.session import get_spark  # noqa: E402

HEADLINE = [
    "a2_summarize_events",   # flagship: JSON decode -> flatten -> conform -> flag -> summary
    "p2_flatten",            # JSON path extraction of every message
    "f3_flag_suspicious",    # rules over the 3-way joined transaction view
    "f6_flag_dormant",       # skew-safe lag per account
    "w1_cumulative",         # skew-safe running total per category
    "a13_box_stats",         # exact quantiles per group
    "a15_kde",               # exact kernel density per group
    "a16_corr_matrix",       # all-pairs correlation in one pass
    "a22_word_counts",       # whole-text tokenisation of documents
    "a25_corridors",         # CUBE over country pairs
    "u2_dedup_earliest",     # min_by de-duplication of repeated ids
    "u3_reconcile",          # source vs landed reconciliation
    "t1_monitor_stream",     # streaming classify-and-route into partitioned CSV
    "t4_dormant_stream",     # stateful stream (per-account state store)
    "s3_write_routed",       # routed, date-partitioned write
    "g5_amount_by_region",   # ad hoc SQL with joins
]


def calibration(spark) -> dict:
    t0 = time.perf_counter()
    sum(i * i for i in range(5_000_000))
    t1 = time.perf_counter()
    spark.range(0, 200_000_000, 1, 8).selectExpr("sum(id % 1000) AS s").collect()
    return {"python": round(t1 - t0, 3), "spark": round(time.perf_counter() - t1, 3)}


def prepared(spark, sf_dir: str) -> dict:
    """Headline queries whose input is made beforehand, as callables without arguments."""
    from txmon.operators import flatten as fl
    from txmon.plans import fixtures as fx
    from txmon.plans import registry as rg
    from txmon.plans.params import EVENT_DORMANT_GAP_SECONDS, EVENT_DORMANT_MIN_VALUE, EVENT_RULES
    from txmon.session import scratch_path
    from txmon.sources.events import decode_events
    from txmon.streaming import dormancy, monitor

    events = fx.table(spark, sf_dir, "events")
    stored = scratch_path(spark, "bench-messages")
    fx.events_to_messages(events).write.parquet(stored)
    slices = fx.stage_time_slices(events, "ts", scratch_path(spark, "bench-slices"), rg.SLICES, rg.SLICE_FILES)

    def routed():
        base, ck = scratch_path(spark, "routed"), scratch_path(spark, "routed-ck")
        messages = fx.events_to_faulty_messages(rg.read_slices(spark, events.schema, slices))
        monitor.run_available(monitor.monitor_stream(messages, base, ck, EVENT_RULES))
        return rg._routed_view(spark, base)

    def dormant():
        flagged = dormancy.dormant_stream(rg.read_slices(spark, events.schema, slices), "user_id", "ts", "value", "event_id",
                                          EVENT_DORMANT_GAP_SECONDS, EVENT_DORMANT_MIN_VALUE)
        return rg._run_to_parquet(flagged, spark, "dormant")

    return {"p2_flatten": lambda: fl.flatten(fl.project_stream(decode_events(spark.read.parquet(stored)))),
            "t1_monitor_stream": routed, "t4_dormant_stream": dormant}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("txmon-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # JVM / Python-worker warm-up on the smallest tables (JIT of the JSON path, streaming and
    # state-store classes), not on the measured data; every measured query reads and writes afresh
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("a2_summarize_events", "f3_flag_suspicious", "t1_monitor_stream", "t4_dormant_stream"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    ready = prepared(spark, sf_dir) if any(n in ("p2_flatten", "t1_monitor_stream", "t4_dormant_stream") for n in names) else {}
    speed = calibration(spark)
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        (ready[name]() if name in ready else QUERIES[name](spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "calibration_sec": speed}))
    spark.stop()


if __name__ == "__main__":
    main()
