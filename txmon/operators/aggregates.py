"""Grouped aggregates behind summaries and charts.

Each returns a small, bounded DataFrame (one row per group / category), computed with
partial aggregation before the shuffle. Money sums stay DECIMAL (exact, order-independent);
averages are ``sum / count`` of the exact sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.operators.segmented import join_on_keys
from txmon.operators.topk import count_categories, top_n
from txmon.session import share_code

try:
    from _md5 import md5  # the interpreter's own: for short texts about half the time of the TLS library's
except ImportError:
    from hashlib import md5


def exact_avg(c: str) -> Column:
    """Mean as exact sum / count (DECIMAL inputs stay exact until the final division)."""
    return F.sum(c).cast("double") / F.count(c)


def row_count(df: DataFrame) -> DataFrame:
    """A1: number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def summarize(df: DataFrame, by, amount: str = "amount_usd", fee: str | None = "fee_usd",
              flag: str | None = None) -> DataFrame:
    """A2: per group: count, sum/avg/min/max of the amount, sum of fees (+ flagged count)."""
    groups = [by] if isinstance(by, str) else list(by)
    aggs = [F.count(F.lit(1)).alias("n_transactions"),
            F.sum(amount).alias("total_amount"),
            exact_avg(amount).alias("avg_amount"),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount")]
    if fee:
        aggs.append(F.sum(fee).alias("total_fee"))
    if flag:
        aggs.append(F.count_if(F.col(flag)).alias("n_suspicious"))
    return df.groupBy(*groups).agg(*aggs)


def group_sum(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """A3 (radar) / A4 (bar, stacked values per x): sum of ``value`` per ``key``."""
    return df.groupBy(key).agg(F.sum(value).alias(out or f"sum_{value}"))


radar_data = group_sum
bar_data = group_sum


def bar_mean_data(df: DataFrame, x: str, y: str, max_x: int | None = None, tie: str | None = None) -> DataFrame:
    """A5: mean of y per x, one row per x value.

    With ``max_x`` (the report's rule, 20) more than that many distinct values of x (NULL not counted)
    narrow the data to the top ``max_x`` *rows* by y; ``showing_only`` marks that case. One aggregate of
    the data answers the small case and counts the values; only the other case reads the rows again."""
    g = df.groupBy(x).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"), F.count(F.lit(1)).alias("n_rows"))

    def means(rows: DataFrame) -> DataFrame:
        return rows.select(x, (F.col("_s").cast("double") / F.col("_c")).alias(f"mean_{y}"), "n_rows")

    if max_x is None:
        return means(g).withColumn("showing_only", F.lit(False))
    k = count_categories(g, x)
    top = top_n(df, max_x, y, tie or x).groupBy(x).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"), F.count(F.lit(1)).alias("n_rows"))
    return (means(g.filter(k <= F.lit(max_x)).unionByName(top.filter(k > F.lit(max_x))))
            .withColumn("showing_only", k > F.lit(max_x)))


def pie_data(df: DataFrame, names: str, values: str, max_categories: int | None = None,
             n_bars: int = 10, tie: str | None = None) -> DataFrame:
    """Pie slices: sum per name and its share of the total (NULL when the total is 0).

    With ``max_categories`` (the report's rule, 10) that many distinct names or more (NULL counts as a
    name) give, if ``values`` is numeric, the top ``n_bars`` rows as a horizontal bar (A7) instead;
    ``chart`` tells which. Slices, total and the number of names come from one aggregate of the data."""
    slices = df.groupBy(names).agg(F.sum(values).alias("value"))
    total = slices.select(F.sum("value")).scalar()
    pie = (slices.withColumn("share", F.try_divide(F.col("value").cast("double"), total.cast("double")))
                 .withColumn("chart", F.lit("pie")))
    if max_categories is None:
        return pie
    k = count_categories(slices, names, count_nulls=True)
    pie = pie.filter(k < F.lit(max_categories))
    if isinstance(df.schema[values].dataType, T.NumericType):
        bars = (hbar_data(df, values, names, n_bars, tie)
                .select(names, F.col(values).alias("value"))
                .withColumn("share", F.lit(None).cast("double"))
                .withColumn("chart", F.lit("hbar"))
                .filter(k >= F.lit(max_categories)))
        pie = pie.unionByName(bars.withColumn("value", F.col("value").cast(pie.schema["value"].dataType)))
    return pie


def hbar_data(df: DataFrame, values: str, names: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """Top-n rows by value (``nlargest``), projected to (names, values)."""
    return top_n(df, n, values, tie or names).select(names, values)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value (NULL dropped), descending, with its percentage to 1 decimal."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()  # of the few counts, not of the rows again
    return counts.withColumn("pct", F.round(F.col("count") * 100.0 / total, 1))


def line_mean_data(df: DataFrame, x: str, y: str, z: float = 1.96) -> DataFrame:
    """Mean of y per x with a normal 95 % interval (mean +- z*sd/sqrt(n)).
    (The plotting library bootstraps its interval: ``line_mean_bootstrap``.)"""
    g = df.groupBy(x).agg(exact_avg(y).alias("mean"), F.stddev_samp(F.col(y).cast("double")).alias("sd"),
                          F.count(y).alias("n"))
    half = F.lit(z) * F.col("sd") / F.sqrt(F.col("n"))
    return g.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


#: 16-bit fractions of a digest, eight to a digest; a fraction's Poisson(1) weight is the number of thresholds it reaches.
_FRACTIONS = 8
_REACHED = [math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def poisson_weights(row_id: Column, block: Column, seed: int) -> list[Column]:
    """Poisson(1) weights of a row in the eight replicates of ``block``, from the MD5 of ``id:seed:block``."""
    digest = F.md5(F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), F.lit(str(seed)), block.cast("string")).cast("binary"))
    fractions = [F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") for i in range(_FRACTIONS)]
    return [sum((F.when(u >= t, 1).otherwise(0) for t in _REACHED[1:]), F.when(u >= _REACHED[0], 1).otherwise(0)) for u in fractions]


#: Rows whose digests are held at once, and values of x whose sums a task holds before it passes them on.
CHUNK_ROWS, HELD_X = 1024, 200


def _weighted_sums(batches: Iterable[pa.RecordBatch], n_boot: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per x and replicate (_x, _b): the sum of weight * y (_s) and of weights (_n) over a task's rows (_x, _id, _y).

    The weights are those of ``poisson_weights``, from one digest per row and block. Decimals are summed exactly, in 32-bit parts: a
    chunk's sums of a part stay far below 2^53."""
    suffixes = [f":{seed}:{block}".encode() for block in range(-(-n_boot // _FRACTIONS))]
    weight_of = np.searchsorted(_REACHED, np.arange(65536), side="right").astype("float64")
    held: dict[str, list] = {}

    def parts(y: pa.Array) -> np.ndarray:
        if not pa.types.is_decimal(y.type):
            return np.column_stack([y.to_numpy(zero_copy_only=False), np.ones(len(y))])
        words = np.frombuffer(y.buffers()[1], "<u4").reshape(-1, 4)[y.offset:y.offset + len(y)]
        return np.column_stack([words[:, :3], words[:, 3].view("<i4"), np.ones(len(y))]).astype("float64")

    def sums(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for x, total in held.values():
            if pa.types.is_decimal(kind):
                whole = sum(total[:, i].astype("int64").astype(object) << 32 * i for i in range(4))
                s = pa.array([Decimal(f"{v}e-{kind.scale}") for v in whole], pa.decimal128(38, kind.scale))
            else:
                s = pa.array(total[:, 0])
            yield pa.RecordBatch.from_arrays([x.take(pa.array(np.zeros(n_boot, "int32"))), pa.array(np.arange(n_boot, dtype="int32")), s, pa.array(total[:, -1].astype("int64"))],
                                             names=["_x", "_b", "_s", "_n"])
        held.clear()

    kind = None
    for batch in batches:
        kind = batch.column("_y").type
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            chunk = batch.slice(start, CHUNK_ROWS)
            names = np.array([repr(v) for v in chunk.column("_x").to_pylist()], dtype=object)
            order = sorted(range(len(names)), key=names.__getitem__)
            names, ids, values = names[order], chunk.column("_id").to_pylist(), parts(chunk.column("_y"))[order]
            digests = b"".join([md5(ids[i] + suffix).digest() for i in order for suffix in suffixes])
            weights = weight_of.take(np.frombuffer(digests, ">u2").reshape(len(order), -1)[:, :n_boot])
            ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for lo, hi in zip([0, *ends], ends):
                total = weights[lo:hi].T @ values[lo:hi]
                if (kept := held.get(names[lo])) is None:
                    held[names[lo]] = [chunk.column("_x").take(pa.array([order[lo]])), total.astype("int64") if pa.types.is_decimal(kind) else total]
                else:
                    kept[1] = kept[1] + (total.astype("int64") if pa.types.is_decimal(kind) else total)
            if len(held) >= HELD_X:
                yield from sums(kind)
    if held:
        yield from sums(kind)


def line_mean_bootstrap(df: DataFrame, x: str, y: str, id_col: str, n_boot: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean of y per x with the plotting library's interval: percentiles of ``n_boot`` bootstrapped means.

    Every row counts in each replicate as often as a Poisson(1) number says that a hash of its id and the replicate gives (a
    multinomial resample in the limit), so one pass sums all replicates side by side: map tasks take one digest per row and eight
    replicates and multiply the weights with y (``_weighted_sums``), and n_boot sums per x and task are shuffled
    however many rows there are; a repeated task or run gives the same interval. Rows that share an id share their
    weights. Missing y (NULL or NaN) are left out; an x with a single value has that value at both ends, a replicate that draws
    no row of an x has no mean there.
    """
    spark = df.sparkSession
    share_code(spark)
    rows = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(id_col).alias("_id")).filter(F.col("_y").isNotNull() & ~F.isnan(F.col("_y").cast("double")))
    kind = rows.schema["_y"].dataType
    number = kind if isinstance(kind, T.DecimalType) else T.DecimalType(20, 0) if isinstance(kind, T.IntegralType) else T.DoubleType()
    summed = T.DecimalType(38, number.scale) if isinstance(number, T.DecimalType) else number
    # the work is in the rows, not in their bytes: equal parts for all tasks, whatever files the rows come from
    spread = rows.select("_x", F.coalesce(F.col("_id").cast("string"), F.lit("null")).cast("binary").alias("_id"), F.col("_y").cast(number).alias("_y")).repartition(
        max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shape = T.StructType([T.StructField("_x", rows.schema["_x"].dataType), T.StructField("_b", T.IntegerType()), T.StructField("_s", summed), T.StructField("_n", T.LongType())])
    sums = (spread.mapInArrow(lambda batches: _weighted_sums(batches, n_boot, seed), shape)
            .groupBy("_x", "_b").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")))
    tail = (1 - level) / 2
    ends = (sums.select("_x", F.try_divide(F.col("_s").cast("double"), F.col("_n")).alias("m"))
            .groupBy("_x").agg(F.percentile("m", [tail, 1 - tail]).alias("_ends")))
    mean = rows.groupBy("_x").agg(exact_avg("_y").alias("mean"), F.count("_y").alias("n"))
    return join_on_keys(mean, ends, ["_x"]).select(F.col("_x").alias(x), "mean", "n", F.col("_ends")[0].alias("ci_low"), F.col("_ends")[1].alias("ci_high"))


def store_distinct(df: DataFrame, columns: list[str], path: str, load: str, lg_k: int = 14) -> None:
    """A23 for a growing table: keep one sketch of each column's distinct values per load (``path/load=...``; a repeated load
    replaces its own). Sketches merge, so a recount reads sketches and never an old load again."""
    sketches = df.agg(*[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(lg_k)).alias(f"_k{i}") for i, c in enumerate(columns)],
                      F.count(F.lit(1)).alias("rows"))
    long = sketches.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_k{i}").alias("sketch")) for i, c in enumerate(columns)])).alias("s"), "rows")
    long.select("s.*", "rows").write.mode("overwrite").parquet(f"{path}/load={load}")


def stored_distinct(spark: SparkSession, path: str) -> DataFrame:
    """Per column: rows, loads and the estimated number of distinct non-NULL values over all stored loads."""
    kept = spark.read.parquet(path)
    return kept.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
                                           F.count(F.lit(1)).alias("n_loads"), F.sum("rows").alias("n_rows"))


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct non-NULL values (HyperLogLog++ when ``approx``)."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(agg.alias("n_distinct"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def corridors(df: DataFrame, sender: str = "sender_country", receiver: str = "receiver_country",
              amount: str = "amount_usd", flag: str | None = None) -> DataFrame:
    """Sender x receiver country totals with every subtotal (CUBE); ``level`` is the
    grouping id (0 = pair, 1 = per sender, 2 = per receiver, 3 = grand total). The pairs are summed
    first and the cube is taken over their sums, so the rows themselves are never multiplied."""
    pairs = df.groupBy(sender, receiver).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_a"), *([F.count_if(F.col(flag)).alias("_f")] if flag else []))
    kind = pairs.schema["_a"].dataType
    aggs = [F.sum("_n").alias("n_transactions"), F.sum("_a").cast(kind).alias("total_amount")]
    if flag:
        aggs.append(F.sum("_f").alias("n_suspicious"))
    return pairs.cube(sender, receiver).agg(*aggs, F.grouping_id().alias("level"))
