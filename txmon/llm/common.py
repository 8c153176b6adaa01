"""Shared helpers of the training-data operators.

Conventions every operator follows:

* a null text counts as the empty text, a null id is an ordinary (smallest) value;
* the caller's columns travel inside one struct (``ROW``) or are projected away, so extra columns
  never clash with working columns; columns an operator adds replace input columns of that name;
* intermediate tables are written below ``spark.checkpoint.dir`` (shared by all executors).
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.session import scratch_path, share_code

ROW = "_row"

#: Text handled at once inside one Python task; longer texts are still handled whole, one by one.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; workers are told where the code lies."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: lineage is cut and survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps: it follows the driver's garbage collection.

    Twice, as what the driver's Python side lets go only becomes garbage of the JVM after that.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def pack(docs: DataFrame, carry: list[str], **working: Column) -> DataFrame:
    """Working columns plus the caller's ``carry`` columns inside the struct ``ROW``."""
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(c) for c in carry])
    return docs.select(row.alias(ROW), *[c.alias(n) for n, c in working.items()])


def unpack(df: DataFrame, row_type, added: dict[str, Column]) -> DataFrame:
    """The caller's columns again, with ``added`` columns in place of any of the same name, in any case."""
    taken = {n.lower() for n in added}
    own = [F.col(ROW)[f].alias(f) for f in row_type.names if f.lower() not in taken]
    return df.select(*own, *[c.alias(n) for n, c in added.items()])


def lean() -> None:
    """Inside a task: Arrow memory goes back to the system when freed, not to a pool that the worker keeps."""
    pa.set_memory_pool(pa.system_memory_pool())


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes at most (or one row)."""
    lean()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(column).nbytes
        if size <= limit or n == 1:
            yield batch
            continue
        lengths = [len(x) if x is not None else 0 for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
        start, held = 0, 0
        for i, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        yield batch.slice(start, n - start)


def held_out(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod ``folds`` is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
