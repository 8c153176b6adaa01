"""Strict message decoding, and files that cannot be read beside files that can."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from txmon.operators.rules import flag_suspicious, route
from txmon.session import scratch_path
from txmon.sources import files as fs
from txmon.sources.events import NO_BODY, decode_events
from txmon.streaming import monitor as pl

GOOD = ['{"transaction_id":"a"}', ' {"transaction_id":"b","amount_usd":1e3} ', '{"transaction_id":5,"amount_usd":1}', '{"transaction_id":"d","extra":[1,{"check":2}]}',
        '{"transaction_id":"e","sender":null}', '{"transaction_id":"f","transaction_id":"g"}', '{"check":1,"transaction_id":"h","message":{}}', '{"transaction_id":"i","reference":"}\\",\\"check\\":1}"}']
BAD = ["", "  ", "{}", "null", "[]", "7", '"s"', "x", '{"transaction_id":null}', '[{"transaction_id":"x"}]', '{"transaction_id":"x"}{"transaction_id":"y"}',
       '{"transaction_id":"x"} tail', '{"transaction_id":"x"}}', '{"transaction_id":"x"}]', '{"transaction_id":"x"},{"a":1}', '{"transaction_id":"x"},"check":1}{"a":1',
       '{"transaction_id":"x","amount_usd":NaN}', '{"transaction_id":"x","amount_usd":-Infinity}', "{'transaction_id':'x'}", '{"transaction_id":"x",}',
       '{"transaction_id":"x","amount_usd":01}', '{"transaction_id":"x","sender":"Bob"}', '{"transaction_id":"x","amount_usd":"5"}', '{"transaction_id":"cut","amount_usd":7', "﻿{}"]


def bodies(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "timestamp int, value string").select("value", F.lit(None).cast("timestamp").alias("timestamp"))


def test_a_message_is_one_object_with_an_id(spark):
    got = decode_events(bodies(spark, GOOD + BAD + [None]))
    assert [r.decode_error for r in got.collect()] == [None] * len(GOOD) + [b if b.strip() else NO_BODY for b in BAD] + [NO_BODY]
    assert {r.route for r in route(got.filter(F.col("decode_error").isNotNull())).collect()} == {"quarantine"}
    ids = [r.transaction_id for r in decode_events(bodies(spark, GOOD + BAD), mode="drop").collect()]
    assert ids == [str(json.loads(g)["transaction_id"]) for g in GOOD]
    assert decode_events(bodies(spark, GOOD), mode="failfast").count() == len(GOOD)
    for bad in ('{"transaction_id":"x"} tail', None, "{}"):
        with pytest.raises(Exception, match="does not decode"):
            decode_events(bodies(spark, [*GOOD, bad]), mode="failfast").collect()


def test_wrong_type_keeps_the_other_fields(spark):
    r = decode_events(bodies(spark, ['{"transaction_id":"t","amount_usd":"5","sender_country":"C"}'])).first()
    assert (r.transaction_id, r.amount_usd, r.sender_country) == ("t", None, "C") and r.decode_error


def test_nan_is_no_high_amount(spark):
    rows = [(float("nan"),), (math.inf,), (-math.inf,), (None,), (1e6,), (999_999.99,)]
    df = spark.createDataFrame(rows, "amount_usd double").withColumns({"sender_country": F.lit("USA"), "receiver_country": F.lit(None).cast("string")})
    assert [r.is_suspicious for r in flag_suspicious(df).collect()] == [False, True, False, False, True, False]


HEADER = "transaction_id,timestamp,amount_usd,sender_country\n"
FILES = {  # bytes, alerts, error
    "good": (HEADER.encode() + b'g1,t,5,AA\n"g2",t,"1,5",""\n', {"g1", "g2"}, None),
    "lines": (HEADER.encode() + b'"l1","two\nlines",6,BB\n\nl2,t,7,CC\n', {"l1", "l2"}, None),
    "order": ("note,sender_country,transaction_id\nx,DD,o1\ny,é,o2\n".encode(), {"o1", "o2"}, None),
    "short": (HEADER.encode() + b"s1,t\ns2,t,8,EE\n", {"s1", "s2"}, None),
    "twice": (HEADER.encode() * 2, {"transaction_id"}, None),
    "only": (HEADER.encode(), set(), None),
    "empty": (b"", set(), None),
    "renamed": (b"id,timestamp\nr1,t\nr2,t\n", set(), "no column transaction_id"),
    "headless": (b"h1,t,5,AA\nh2,t,5,AA\n", set(), "no column transaction_id"),
    "ragged": (HEADER.encode() + b"w1,t,5,AA\nw2,t,5,AA,more\n", set(), "a row has more cells than the header"),
    "latin": (HEADER.encode() + b"x1,t,5,\xe9\xff\n", set(), "not UTF-8 text"),
    "wide": (HEADER.encode() + b"y1" + b",z" * 70 + b"\n", set(), "64 cells or more in a row"),
}


def put(base, name, day):
    folder = os.path.join(base.removeprefix("file:"), "2024", "05", f"{day:02}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.csv"), "wb") as f:
        f.write(FILES[name][0])


def test_a_bad_file_gives_one_error_alert_and_the_others_alert(spark):
    base, out, ck = (scratch_path(spark, n) for n in ("files", "alerts", "alerts-ck"))
    for k, name in enumerate(FILES):
        if name not in ("order", "latin"):
            put(base, name, 1 + k % 3)
    run = lambda: pl.run_available(pl.alert_stream(spark, base, out, ck, layout="plain", maxFilesPerTrigger=4))
    run()
    put(base, "order", 9), put(base, "latin", 9)  # the stream goes on after bad files
    run(), run()
    alerts, errors = {}, {}
    for r in spark.read.parquet(out).collect():
        name = r.source_file.rpartition("/")[2].removesuffix(".csv")
        if r.route == "file_error":
            assert name not in errors and r.transaction_id is None
            assert r.message == f":x: *ERROR PROCESSING FILE*\nFile: {r.source_file}\nError: {r.decode_error}"
            errors[name] = r.decode_error
        else:
            assert r.message.startswith(":rotating_light:") and f"*ID:* {r.transaction_id}" in r.message
            alerts.setdefault(name, []).append(r.transaction_id)
    assert errors == {n: e for n, (_, _, e) in FILES.items() if e}
    assert {n: set(v) for n, v in alerts.items()} == {n: a for n, (_, a, _) in FILES.items() if a}
    assert all(len(v) == len(set(v)) for v in alerts.values())


def test_cells_are_taken_by_name(spark):
    base = scratch_path(spark, "files")
    for name in ("good", "lines", "order", "short"):
        put(base, name, 1)
    good, bad = fs.by_header(fs.read_file_rows(spark, base, layout="plain"), ["sender_country", "transaction_id", "amount_usd"])
    got = {r.transaction_id: (r.sender_country, r.amount_usd, r.year, r.month, r.day, r.route) for r in good.collect()}
    day = ("2024", "05", "01", "suspicious")
    assert got == {"g1": ("AA", "5", *day), "g2": (None, "1,5", *day), "l1": ("BB", "6", *day), "l2": ("CC", "7", *day), "o1": ("DD", None, *day),
                   "o2": ("é", None, *day), "s1": (None, None, *day), "s2": ("EE", "8", *day)}
    assert bad.count() == 0


def test_rows_of_a_large_file_are_neither_sorted_nor_shuffled_nor_kept(spark):
    base = scratch_path(spark, "files")
    for name in ("good", "ragged"):
        put(base, name, 1)
    rows = fs.read_file_rows(spark, base, layout="plain")
    assert all(len(r.cells) == r.width for r in fs._numbered(rows).collect())  # not 64 cells a row
    good, bad = fs.by_header(rows)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    kept = fs.file_heads(rows).persist()
    assert {(r.source_file.rpartition("/")[2], r.error) for r in kept.collect()} == {("good.csv", None), ("ragged.csv", "a row has more cells than the header")}
    plan = fs.by_header(rows, files=kept)[1]._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    kept.unpersist()
