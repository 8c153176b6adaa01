"""What the keyed streaming operators share: time in microseconds, ordered segments, a map-side step before state.

A hot key's rows would all go to the one task that holds its state. The operators therefore cut each key's time into
segments, so short that rows of one segment can be told from their extremes alone, and every map task reduces its rows to
one per (key, segment) before the shuffle. The state step then sees segments, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.session import share_code

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: Reduced rows that a map task holds before it reduces them once more or passes them on.
HELD_ROWS = 200_000


def prepare(spark: SparkSession) -> None:
    """Keyed state with timers needs RocksDB; a stream that already has a checkpoint keeps its own provider."""
    share_code(spark)
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def interval_micros(text: str) -> Column:
    """Microseconds of an interval such as ``2 hours``, as a constant."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {text}"))


def segment_of(micros: Column, length: Column | int) -> Column:
    """Number of the segment; negative times (before 1970) count downwards."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.call_function("div", micros - F.pmod(micros, n), n)


def reduced(batches: Iterable[pd.DataFrame], reduce: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``reduce`` over all batches of a map task; what it holds stays bounded."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if len(batch):
            held.append(reduce(batch))
            size += len(held[-1])
        if size >= HELD_ROWS:
            both = reduce(pd.concat(held, ignore_index=True))
            held, size = [both], len(both)
            if size >= HELD_ROWS // 2:
                yield both
                held, size = [], 0
    if held:
        yield reduce(pd.concat(held, ignore_index=True)) if len(held) > 1 else held[0]


def before_state(df: DataFrame, reduce: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The map-side step: the same columns, one row per (key, segment) and map task."""
    return df.mapInPandas(lambda batches: reduced(batches, reduce), df.schema)
