"""Compaction of folders of many small files (S3, T6, T7) without touching what wrote them.

A stream's folder keeps its own files and commit log; the compacted copy lies beside it, as generations. One generation holds the
rows of all files that were committed, and not compacted yet, when it was made: each row keeps its columns and the file it
came from. A generation counts once its list of source files is written, which is the last step, so a compaction that
fails leaves nothing that a reader would see, and the next run overwrites it. Readers take the generations plus the committed files
that no list names.

* the routed folder is listed through the file sink's commit log: files of failed or unfinished batches are left alone;
* ``batch_id=N`` folders are listed without the newest one, which a restarted stream may still replay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txmon.session import ensure_folder
from txmon.sources.files import CSV_OPTIONS, PARTITION_COLUMNS, ROUTED_CSV_SCHEMA, read_routed, with_folder_columns


def _generations(spark: SparkSession, target: str) -> list[str]:
    """Finished generations: those whose file list was written whole."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{target}/lists")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(n.partition("=")[2] for n in names)


def _listed(spark: SparkSession, target: str) -> set[str]:
    found = _generations(spark, target)
    return {r.file for n in found for r in spark.read.parquet(f"{target}/lists/generation={n}").select("file").collect()}


def _add(spark: SparkSession, target: str, files: list[str], rows: DataFrame, partitions: list[str]) -> None:
    n = f"{len(_generations(spark, target)):06}"
    out = rows.hint("rebalance", *partitions) if partitions else rows.hint("rebalance")
    out.write.mode("overwrite").partitionBy(*partitions).parquet(f"{target}/rows/generation={n}")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(f"{target}/lists/generation={n}")


def _compacted(spark: SparkSession, target: str) -> DataFrame | None:
    parts = [spark.read.option("recursiveFileLookup", "false").parquet(f"{target}/rows/generation={n}") for n in _generations(spark, target)]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- the routed folder --------------------------------------------------------------------------

def _routed_files(spark: SparkSession, base: str, files: list[str], schema, **opts) -> DataFrame:
    return with_folder_columns(spark.read.schema(schema).options(**CSV_OPTIONS).options(**opts).csv(files))


def compact_routed(spark: SparkSession, base: str, target: str, schema=ROUTED_CSV_SCHEMA, **opts) -> int:
    """Add a generation with the routed folder's files that are in none yet; by route, year and month. Returns how many files."""
    ensure_folder(spark, base)
    done = _listed(spark, target)
    files = [f for f in read_routed(spark, base, schema=schema, **opts).inputFiles() if f not in done]
    if files:
        _add(spark, target, files, _routed_files(spark, base, files, schema, **opts), ["route", "year", "month"])
    return len(files)


def read_routed_compacted(spark: SparkSession, base: str, target: str, schema=ROUTED_CSV_SCHEMA, **opts) -> DataFrame:
    """The rows of ``read_routed``: compacted ones and those of files since."""
    done = _listed(spark, target)
    live = read_routed(spark, base, schema=schema, **opts)
    rest = [f for f in live.inputFiles() if f not in done]
    packed = _compacted(spark, target)
    if packed is None:
        return live
    packed = packed.select(*[F.col(c).cast("string").alias(c) if c in PARTITION_COLUMNS else F.col(c) for c in live.columns])
    packed = packed.withColumn("month", F.lpad("month", 2, "0"))  # folder values may be read as numbers
    return packed.unionByName(_routed_files(spark, base, rest, schema, **opts)) if rest else packed


# --- folders of micro-batches -------------------------------------------------------------------

def _batches(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    done = [s.getPath() for s in found if s.getPath().getName().startswith("batch_id=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted((int(p.getName().partition("=")[2]), p.toString()) for p in done)


def compact_batches(spark: SparkSession, folder: str, target: str, reduce: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Add a generation with all finished ``batch_id=N`` folders but the newest; returns how many. ``reduce`` may drop rows that
    readers would drop, for example superseded states of a window (``latest``)."""
    done = _listed(spark, target)
    parts = [(n, p) for n, p in _batches(spark, folder)[:-1] if f"batch_id={n}" not in done]
    if parts:
        rows = spark.read.option("basePath", folder).parquet(*[p for _, p in parts])
        _add(spark, target, [f"batch_id={n}" for n, _ in parts], reduce(rows) if reduce else rows, [])
    return len(parts)


def read_batches(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The rows of all micro-batches with their ``batch_id``, compacted or not."""
    done = _listed(spark, target)
    rest = [p for n, p in _batches(spark, folder) if f"batch_id={n}" not in done]
    packed = _compacted(spark, target)
    live = spark.read.option("basePath", folder).parquet(*rest) if rest else None
    if packed is None:
        return live if live is not None else spark.read.parquet(folder)
    return packed.unionByName(live) if live is not None else packed


def latest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows with equal keys the one of the newest batch."""
    def reduce(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id").cast("long")).alias("_last")).select(*keys, "_last.*")

    return reduce
