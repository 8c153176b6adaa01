"""SQL and report surface."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def register_view(df: DataFrame, name: str) -> None:
    """G1: expose a DataFrame to SQL (temp views are read-only)."""
    df.createOrReplaceTempView(name)


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact number of distinct non-NULL values (``distinct_count``) by ``position`` of the column.

    A row gives one short row per column, the position and the value in a column of its type: few values are merged in
    the map tasks, and only distinct ones are shuffled. (A distinct count of each column in one aggregate expands a row into as many
    whole rows and sorts them all.)"""
    kinds = list(dict.fromkeys(f.dataType for f in df.schema.fields))

    def value(i: int, field) -> Column:
        c = F.col(f"`{field.name}`")
        return F.struct(F.lit(i).alias("position"), *[(c if k == field.dataType else F.lit(None).cast(k)).alias(f"v{j}") for j, k in enumerate(kinds)])

    values = df.select(F.explode(F.array(*[value(i, f) for i, f in enumerate(df.schema.fields)])).alias("e")).select("e.*")
    known = reduce(lambda a, b: a | b, [F.col(f"v{j}").isNotNull() for j, _ in enumerate(kinds)])
    return values.filter(known).distinct().groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))


def describe_table(df: DataFrame, exact_distinct: bool = False, rsd: float = 0.02) -> DataFrame:
    """One row per column: type, rows, NULL count, distinct count, min, max (as text) and the value
    of the sample row (the first row in the order of all columns' text).

    Every column is summarised in a single aggregate pass. Distinct counts default to
    HyperLogLog++ with relative error ``rsd`` (bounded memory, no re-expansion of the input); ``exact_distinct=True``
    counts exactly, in a second pass (``distinct_counts``).
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        nd = F.lit(None).cast("long") if exact_distinct else F.approx_count_distinct(c, rsd)
        orderable = f.dataType.typeName() not in ("struct", "array", "map", "binary", "variant")
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), nd.alias(f"d{i}"),
                 (F.min(c).cast("string") if orderable else F.lit(None).cast("string")).alias(f"lo{i}"),
                 (F.max(c).cast("string") if orderable else F.lit(None).cast("string")).alias(f"hi{i}")]
    text = [F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() not in ("struct", "array", "map", "variant")
            else F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields]
    aggs.append(F.min(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(text)])).alias("_sample"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("null_count"),
                     F.col(f"d{i}").alias("distinct_count"), F.col(f"lo{i}").alias("min_value"),
                     F.col(f"hi{i}").alias("max_value"), F.col(f"_sample.s{i}").alias("sample_value"))
            for i, f in enumerate(df.schema.fields)]
    table = wide.select(F.col("_rows").alias("row_count"), F.explode(F.array(*rows)).alias("c")).select("c.*", "row_count")
    if not exact_distinct:
        return table
    counts = distinct_counts(df).select(F.col("position").alias("_at"), F.col("distinct_count").alias("_exact"))
    found = table.join(counts, F.col("position") == F.col("_at"), "left")
    return found.select(*[F.coalesce("_exact", F.lit(0)).alias(c) if c == "distinct_count" else F.col(c) for c in table.columns])


def run_reports(spark: SparkSession, topics: dict[str, str]) -> dict[str, DataFrame | Exception]:
    """Topic -> SQL -> lazy DataFrame. A query that fails analysis yields its exception for
    that topic only; the others still run."""
    out: dict[str, DataFrame | Exception] = {}
    for topic, sql in topics.items():
        try:
            out[topic] = spark.sql(sql)
        except (AnalysisException, ParseException) as e:
            out[topic] = e
    return out


def run_count(df: DataFrame) -> int:
    """Run a whole query, every column of every row, and return its number of rows (one action)."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def report_status(spark: SparkSession, reports: dict[str, DataFrame | Exception]) -> DataFrame:
    """Per topic: status ok / empty / error and the row count: one action per topic. A query that
    fails while it runs is an error of its own topic only."""
    rows = []
    for topic, df in reports.items():
        try:
            n = None if isinstance(df, Exception) else run_count(df)
        except PySparkException:
            n = None
        rows.append((topic, "error" if n is None else "ok" if n else "empty", n))
    return spark.createDataFrame(rows, "topic string, status string, n_rows long")


# The standard questions (type summary, latest 5, measure over time, measure by
# region, share by segment), written for the flat table ``txn`` and the customer tables.
STANDARD_REPORTS = {
    "type_summary": """
        SELECT transaction_type, COUNT(*) AS n_transactions, SUM(amount_usd) AS total_amount,
               SUM(amount_usd) / COUNT(amount_usd) AS avg_amount, SUM(fee_usd) AS total_fee
        FROM txn GROUP BY transaction_type""",
    "latest_5": """
        SELECT transaction_id, transactiondate, amount_usd FROM txn
        ORDER BY transactiondate DESC, transaction_id LIMIT 5""",
    "amount_over_time": """
        SELECT date_trunc('MONTH', transactiondate) AS month, SUM(amount_usd) AS total_amount,
               COUNT(*) AS n_transactions
        FROM txn GROUP BY date_trunc('MONTH', transactiondate)""",
    "amount_by_region": """
        WITH cust_region AS (
          SELECT CAST(c.c_custkey AS STRING) AS account, r.r_name
          FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
          JOIN region r ON n.n_regionkey = r.r_regionkey)
        SELECT cr.r_name AS region, SUM(t.amount_usd) AS total_amount, COUNT(*) AS n_transactions
        FROM txn t JOIN cust_region cr ON t.sender_account_number = cr.account
        GROUP BY cr.r_name""",
    "share_by_segment": """
        WITH s AS (
          SELECT c.c_mktsegment AS segment, SUM(t.amount_usd) AS total_amount
          FROM txn t JOIN customer c ON t.sender_account_number = CAST(c.c_custkey AS STRING)
          GROUP BY c.c_mktsegment)
        SELECT segment, total_amount,
               CAST(total_amount AS DOUBLE) / CAST((SELECT SUM(total_amount) FROM s) AS DOUBLE) AS share
        FROM s""",
}


def standard_reports(spark: SparkSession) -> dict[str, DataFrame | Exception]:
    """The five canned reports (needs the ``txn``, ``customer``, ``nation``, ``region`` views)."""
    return run_reports(spark, STANDARD_REPORTS)
