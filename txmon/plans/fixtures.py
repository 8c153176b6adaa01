"""Views that map the driver's test tables onto the transaction data model.

* ``txn``        one flat-schema row per order (orders x customer x nation x nation)
* ``raw_events`` one JSON text message per ``events`` row, shaped like a bus message
* ``transfers``  one row per line item; the id is *not* unique (dedup / reconcile input)

Every view is a lazy DataFrame over the parquet files, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.schemas import FLAT_SCHEMA, MONEY
from txmon.functions.money import expected_fee

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Payment channels of the metadata object, in order.
CHANNELS = ["MOBILE_APP", "WEB", "BRANCH", "API"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def channel_of(key: Column) -> Column:
    expr = F.when(key % 4 == 0, F.lit(CHANNELS[0]))
    for i, ch in enumerate(CHANNELS[1:], start=1):
        expr = expr.when(key % 4 == i, F.lit(ch))
    return expr


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sn = nation.select(F.col("n_nationkey").alias("s_nk"), F.col("n_name").alias("s_country"))
    rn = nation.select(F.col("n_nationkey").alias("r_nk"), F.col("n_name").alias("r_country"))
    # nation is a fixed 25-row dimension; the planner broadcasts it from its statistics.
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(sn, F.col("c_nationkey") == F.col("s_nk"))
          .join(rn, (F.col("o_orderkey") % 25) == F.col("r_nk")))
    key, receiver = F.col("o_orderkey"), F.col("o_orderkey") % 500
    amount = F.col("o_totalprice").cast(MONEY)
    ts = F.col("o_orderdate").cast("timestamp")

    def numbered(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    cols = {
        "transaction_id": key.cast("string"),
        "transactiondate": ts,
        "sender_name": F.col("c_name"),
        "sender_address": numbered("street ", F.col("c_custkey") % 90),
        "sender_account_number": F.col("c_custkey").cast("string"),
        "sender_bank_name": numbered("BANK_", F.col("c_nationkey")),
        "sender_swift_code": F.when(F.col("c_custkey") % 3 > 0, numbered("SW", F.col("c_nationkey"))),
        "receiver_name": numbered("receiver ", receiver),
        "receiver_address": F.when(receiver % 4 > 0, numbered("road ", receiver)),
        "receiver_account_number": receiver.cast("string"),
        "receiver_bank_name": numbered("BANK_", F.col("r_nk")),
        "receiver_swift_code": numbered("SW", F.col("r_nk")),
        "amount_usd": amount,
        "sender_country": F.col("s_country"),
        "receiver_country": F.col("r_country"),
        "transaction_type": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"),
        "fee_usd": expected_fee(amount),
        "reference": numbered("REF-", key),
        "processing_time": ts,
        "ip_address": numbered("10.0.0.", F.col("c_custkey") % 250),
        "device_id": F.when(key % 5 > 0, numbered("dev-", F.col("c_custkey") % 40)),
        "user_agent": F.lit(None).cast("string"),
        "channel": channel_of(key),
    }
    return j.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in FLAT_SCHEMA.fields])


def iso_text(ts: Column) -> Column:
    """ISO-8601 without zone; the fraction is left out when the microseconds are 0."""
    with_frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(ts, "SSSSSS") == "000000",
                  F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(with_frac)


def events_to_messages(events: DataFrame) -> DataFrame:
    """``events`` rows -> bus messages (key, value JSON text, timestamp = ingest time)."""
    event, user = F.col("event_id"), F.col("user_id")

    def numbered(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    body = F.struct(
        event.cast("string").alias("transaction_id"),
        iso_text(F.col("ts")).alias("timestamp"),
        F.struct(numbered("user_", user).alias("name"), numbered("street ", user % 90).alias("address"),
                 user.cast("string").alias("account_number"), numbered("BANK_", user % 7).alias("bank_name"),
                 F.when(user % 3 > 0, numbered("SW", user % 7)).alias("swift_code")).alias("sender"),
        F.struct(numbered("user_", event % 1000).alias("name"), (event % 1000).cast("string").alias("account_number")).alias("receiver"),
        F.col("value").alias("amount_usd"),
        numbered("NATION_", user % 25).alias("sender_country"),
        numbered("NATION_", event % 25).alias("receiver_country"),
        F.col("event_type").alias("transaction_type"),
        F.when(event % 10 > 0, F.lit("OK")).otherwise(F.lit("FAILED")).alias("status"),
        (event % 50).cast("double").alias("fee_usd"),
        F.when(event % 2 > 0, numbered("REF-", event)).alias("reference"),
        F.struct(numbered("10.0.0.", user % 250).alias("ip_address"), F.get_json_object("props", "$.k").alias("device_id"),
                 channel_of(event).alias("channel")).alias("metadata"),
    )
    return events.select(event.cast("string").alias("key"),
                         F.to_json(body).alias("value"),
                         F.col("ts").cast("timestamp").alias("timestamp"))


def events_to_faulty_messages(events: DataFrame) -> DataFrame:
    """As ``events_to_messages``, with the faults a bus brings: every 97th message has lost its end (malformed
    JSON), every 89th carries its amount as text (a wrong type), every 83rd has no body, every 79th is two objects run
    together, every 73rd has NaN as its amount and every 71st is an empty object."""
    key = F.col("key").cast("long")
    amount = r'"amount_usd":([0-9.eE+-]+)'
    value = (F.when(key % 97 == 0, F.expr("substring(value, 1, length(value) - 1)"))
             .when(key % 89 == 0, F.regexp_replace("value", amount, '"amount_usd":"$1"'))
             .when(key % 83 == 0, F.lit(None).cast("string"))
             .when(key % 79 == 0, F.concat("value", F.lit('{"transaction_id":"again"}')))
             .when(key % 73 == 0, F.regexp_replace("value", amount, '"amount_usd":NaN'))
             .when(key % 71 == 0, F.lit("{}"))
             .otherwise(F.col("value")))
    return events_to_messages(events).withColumn("value", value)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_messages(table(spark, sf_dir, "events"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_suppkey").alias("account"),
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
    )


def register_fixtures(spark: SparkSession, sf_dir: str) -> None:
    txn(spark, sf_dir).createOrReplaceTempView("txn")
    raw_events(spark, sf_dir).createOrReplaceTempView("raw_events")
    transfers(spark, sf_dir).createOrReplaceTempView("transfers")


def redelivered(messages: DataFrame) -> DataFrame:
    """Every 5th message of ``messages`` arrives a second time, unchanged."""
    return messages.unionByName(messages.filter(F.col("key").cast("long") % 5 == 0))


def transfers_of(lineitem: DataFrame) -> DataFrame:
    """``transfers`` projection of any (batch or streaming) lineitem DataFrame."""
    return lineitem.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_suppkey").alias("account"))


def stage_time_slices(df: DataFrame, ts: str, path: str, n: int, files: int = 8, order: list[int] | None = None) -> str:
    """Test staging for multi-batch streams: write ``df`` under ``path`` as ``n`` event-time
    slices, oldest first, each an ordinary parallel write of exactly ``files`` files (round-robin
    repartition, no single-task funnel). The file source takes the oldest files first, so a stream
    with ``maxFilesPerTrigger=files`` reads one whole slice per micro-batch, in event-time order.
    ``order`` writes the slices in another order (late data). Only used to drive streams over the test tables."""
    t = F.col(ts).cast("timestamp").cast("double")
    st = df.select(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).scalar()  # one job for both bounds
    lo, hi = st["lo"], st["hi"]
    b = F.when(hi > lo, F.least(F.floor((t - lo) * F.lit(float(n)) / (hi - lo)), F.lit(n - 1))).otherwise(0)
    sliced = df.withColumn("_slice", b)
    spark = df.sparkSession
    for i in order or range(n):
        out = f"{path}/slice_{i:03d}"
        sliced.filter(F.col("_slice") == i).drop("_slice").repartition(files).write.mode("overwrite").parquet(out)
        written = len(spark.read.parquet(out).inputFiles())
        if written != files:  # a short slice would let one micro-batch straddle two slices
            raise ValueError(f"slice {i} has {written} files, expected {files}")
    return path
