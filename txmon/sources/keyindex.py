"""Which folders of a large table may hold a key: blocked Bloom filters per period, stored beside the table.

A key sets ``HASHES`` bits in one block of ``BITS`` bits, so one row of the index answers for a key. A period has as many blocks (a power of
two) as its load had keys for; every load adds rows, and rows of one block are united when read. A filter never
misses a key, it may name a period too many: the folders it names are read and compared exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap of Spark's bitmap functions, bits set per key, and bits planned per key (about 1 in 200 false answers).
BITS, HASHES, BITS_PER_KEY = 32768, 6, 12

#: One key in so many is asked of every period first.
FIRST_ASKED = 64

SCHEMA = "period string, blocks long, block long, bits binary"


def _place(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS))


def _places(key: Column) -> Column:
    return F.array(*[_place(key, i) for i in range(HASHES)])


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), blocks)


def _holds(bits: Column, key: Column) -> Column:
    """One condition per hash, no lambda: it is compiled into the join, which then never copies a bitmap per row."""
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (place % 8).cast("int")) == 1

    return reduce(lambda a, b: a & b, [is_set(_place(key, i)) for i in range(HASHES)])


def index_of(rows: DataFrame) -> DataFrame:
    """Index rows of (period, key): one 4 KB bitmap per period and block."""
    sizes = rows.groupBy("period").agg(F.count("*").alias("_n"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_n") * BITS_PER_KEY / BITS)))).cast("long")
    sized = rows.join(sizes.select("period", blocks.alias("blocks")), "period")
    return (sized.select("period", "blocks", _block(F.col("key"), F.col("blocks")).alias("block"), F.explode(_places(F.col("key"))).alias("_place"))
            .groupBy("period", "blocks", "block").agg(F.bitmap_construct_agg("_place").alias("bits")))


def candidates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, period) for every stored period that may hold a key of ``keys``.

    First all periods' bitmaps of a block are united and keys that are in none are dropped: new keys meet one row each and
    end there. Only the rest is asked of each period."""
    united = index.groupBy("blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = index.select("blocks").distinct()  # powers of two: a few dozen at most
    of_size = F.explode(sizes.select(F.collect_set("blocks")).scalar())
    asked = keys.select("key", of_size.alias("blocks")).withColumn("block", _block(F.col("key"), F.col("blocks")))
    maybe = asked.join(united, ["blocks", "block"]).filter(_holds(F.col("bits"), F.col("key"))).select("key", "blocks", "block")
    by_period = index.groupBy("period", "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return maybe.join(by_period, ["blocks", "block"]).filter(_holds(F.col("bits"), F.col("key"))).select("key", "period").distinct()


def candidate_periods(keys: DataFrame, index: DataFrame) -> list[str]:
    """Every stored period that may hold a key of ``keys``: those of ``candidates``.

    Most periods that hold keys are named by few of them: one key in ``FIRST_ASKED`` is asked of all periods, then every key of the
    periods that are not named yet."""
    def named(some: DataFrame, periods: DataFrame) -> list[str]:
        return [r.period for r in candidates(some, periods).select("period").distinct().collect()]  # at most one per folder

    first = named(keys.filter(F.pmod(F.xxhash64("key", F.lit(-2)), F.lit(FIRST_ASKED)) == 0), index)
    rest = index.filter(~F.col("period").isin(first)) if first else index
    return sorted([*first, *named(keys, rest)])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index; empty before the first load."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
