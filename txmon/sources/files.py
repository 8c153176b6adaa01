"""File and table sources."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.session import ensure_folder

# Text columns of a routed CSV file (nested parts are JSON text).
ROUTED_COLUMNS = ["transaction_id", "timestamp", "sender", "receiver", "amount_usd", "sender_country",
                  "receiver_country", "transaction_type", "status", "fee_usd", "reference", "metadata",
                  "flag_reasons", "decode_error"]
PARTITION_COLUMNS = ["route", "year", "month", "day"]
ROUTED_CSV_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ROUTED_COLUMNS])

# PERMISSIVE: a malformed line becomes a row of NULLs instead of failing the file. Message
# decoding errors travel in the data's own ``decode_error`` column. The header must name the
# schema's columns in order: a file with other columns fails instead of being read by position.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8",
               "mode": "PERMISSIVE", "enforceSchema": "false"}


def with_folder_columns(df: DataFrame) -> DataFrame:
    """``source_file`` and the folder values ``route/year/month/day`` as text, taken from each row's file.

    Taken from the path, they are there before the first file is, and the schema stays the file's own
    columns, so headers are checked. A filter on them is one on the file's path: other files are not opened."""
    path = F.col("_metadata.file_path")

    def value(c: str) -> Column:
        found = F.regexp_extract(path, rf"/{c}=([^/]*)/", 1)
        return F.coalesce(F.nullif(found, F.lit("")), F.col(c)) if c in df.columns else found  # coarser folders keep it as a column

    return df.withColumns({"source_file": path, **{c: value(c) for c in PARTITION_COLUMNS}})


def with_plain_folder(df: DataFrame, route: str = "suspicious") -> DataFrame:
    """The same for folders ``YYYY/MM/DD`` that hold one route."""
    path = F.col("_metadata.file_path")
    m = r"/(\d{4})/(\d{2})/(\d{2})/[^/]+$"
    return df.withColumns({"source_file": path, "route": F.lit(route), "year": F.regexp_extract(path, m, 1),
                           "month": F.regexp_extract(path, m, 2), "day": F.regexp_extract(path, m, 3)})


def read_routed(spark: SparkSession, base: str, streaming: bool = False,
                schema: T.StructType | str = ROUTED_CSV_SCHEMA, **opts) -> DataFrame:
    """All routes of the routed sink's folder ``base`` (``route=/year=/month=/day=``), read through its
    commit log: files that a failed or unfinished batch left behind are never read. A folder without
    files yet gives no rows."""
    ensure_folder(spark, base)
    reader = spark.readStream if streaming else spark.read
    return with_folder_columns(reader.schema(schema).options(**CSV_OPTIONS).options(**opts).option("recursiveFileLookup", "true").csv(base))


def read_suspicious(spark: SparkSession, base: str, streaming: bool = False, layout: str = "hive",
                    schema: T.StructType = ROUTED_CSV_SCHEMA, route: str = "suspicious", **opts) -> DataFrame:
    """One route's CSV files with an explicit schema; ``source_file`` is each row's file.

    ``layout="hive"`` keeps one route of ``read_routed``; ``layout="plain"`` reads ``base/YYYY/MM/DD/*.csv`` and takes
    the date from the path. Empty files yield no rows.
    """
    if layout != "plain":
        return read_routed(spark, base, streaming, schema, **opts).filter(F.col("route") == route)
    reader = spark.readStream if streaming else spark.read
    df = (reader.schema(schema).options(**CSV_OPTIONS).options(**opts)
                .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(base))
    return with_plain_folder(df, route)


#: Cells read of a row while the file's header is not known; a file that fills the last one is reported as an error.
MAX_CELLS = 64


def read_file_rows(spark: SparkSession, base: str, streaming: bool = False, layout: str = "hive", **opts) -> DataFrame:
    """Every row of every CSV file as it stands, header rows included: ``cells`` and ``width`` (cells up to the last
    that is not empty), ``source_file`` and the folder values. No file can fail the read, whatever its columns;
    ``by_header`` sorts the files out. Layouts as in ``read_suspicious``; ``hive`` keeps all routes."""
    ensure_folder(spark, base)
    reader = spark.readStream if streaming else spark.read
    names = [f"c{i}" for i in range(MAX_CELLS)]
    reader = reader.schema(", ".join(f"{n} string" for n in names)).options(**{**CSV_OPTIONS, "header": "false"}).options(**opts)
    df = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(base)
    width = F.greatest(*[F.when(F.col(n).isNotNull(), F.lit(i + 1)).otherwise(0) for i, n in enumerate(names)])
    df = with_folder_columns(df) if layout != "plain" else with_plain_folder(df)
    return df.select(F.array(*names).alias("cells"), width.alias("width"), "source_file", *PARTITION_COLUMNS)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows that have cells, up to the last one, with numbers that ascend within a file."""
    return rows.filter("width > 0").withColumns({"cells": F.slice("cells", F.lit(1), F.col("width")), "_row": F.monotonically_increasing_id()})


def file_heads(rows: DataFrame, required: tuple = ("transaction_id",)) -> DataFrame:
    """One row per file of ``read_file_rows``: its first row's number (_first) and cells (_names), and ``error`` where it is unreadable.
    (The set of faults keeps this a hash aggregate: nothing sorts a file's rows for its first one.)"""
    files = _numbered(rows).groupBy("source_file", *PARTITION_COLUMNS).agg(
        F.min("_row").alias("_first"), F.min_by(F.struct("cells", "width"), "_row").alias("_head"), F.max("width").alias("_widest"),
        F.collect_set(F.when(F.exists("cells", lambda c: c.contains("\ufffd")), F.lit("not UTF-8 text"))).alias("_faults"))
    names = F.col("_head.cells")
    errors = [F.get("_faults", F.lit(0)),
              *[F.when(~F.array_contains(names, c) | F.array_contains(names, c).isNull(), F.lit(f"no column {c}")) for c in required],
              F.when(F.col("_widest") >= MAX_CELLS, F.lit(f"{MAX_CELLS} cells or more in a row")),
              F.when(F.col("_widest") > F.col("_head.width"), F.lit("a row has more cells than the header"))]
    return files.select("source_file", *PARTITION_COLUMNS, "_first", names.alias("_names"), F.coalesce(*errors).alias("error"))


def by_header(rows: DataFrame, columns: list[str] = ROUTED_COLUMNS, required: tuple = ("transaction_id",), files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of readable files, unreadable files) of ``read_file_rows``.

    Each file's first row names its columns: cells are taken by name, in whatever order the file has them, columns it does
    not have are NULL, others are left out. A file is unreadable, as a whole, with a reason in ``error``: a ``required``
    column is missing, a row has more cells than the header, there are ``MAX_CELLS`` cells or more, or the bytes
    are not UTF-8 (the reader puts U+FFFD for those). A file with nothing but a header gives no rows.

    The files are read once for their heads and once for their rows, which never leave the task that reads them: the heads, one
    per file, are sent to all tasks. Pass ``files`` (``file_heads``, persisted) to share the first read among both results. A file is read
    by one task (its rows may span lines), so the row numbers that find its first row ascend within it.
    """
    files = file_heads(rows, required) if files is None else files
    bad = files.filter("error IS NOT NULL").select("source_file", *PARTITION_COLUMNS, "error")
    heads = files.filter("error IS NULL").select(F.col("source_file").alias("_file"), "_first", "_names")
    good = _numbered(rows).join(F.broadcast(heads), (F.col("source_file") == F.col("_file")) & (F.col("_row") != F.col("_first")))
    at = {c: F.coalesce(F.array_position("_names", c), F.lit(0)).cast("int") for c in columns}
    return good.select(*[F.when(at[c] > 0, F.try_element_at("cells", at[c])).alias(c) for c in columns], "source_file", *PARTITION_COLUMNS), bad


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """``SELECT * FROM name`` (a catalog table or temp view)."""
    return spark.table(name)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Any query text, unchanged (CTEs, subqueries, joins...)."""
    return spark.sql(sql)


#: Most results kept; the one not used for longest goes first.
CACHE_SIZE = 32
_CACHE: OrderedDict[tuple, DataFrame] = OrderedDict()


def _cache_key(spark: SparkSession, df: DataFrame) -> tuple:
    return spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), df.semanticHash()


def cached_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Result cache (persisted lazily on first use), per session and analysed plan: the same
    question is answered from the cache, also in other words, and a replaced view is a new plan."""
    df = spark.sql(sql)
    key = _cache_key(spark, df)
    kept = _CACHE.get(key)
    if kept is not None and kept.sameSemantics(df):
        _CACHE.move_to_end(key)
        return kept
    _CACHE[key] = df.persist()
    while len(_CACHE) > CACHE_SIZE:
        _CACHE.popitem(last=False)[1].unpersist()
    return df


def uncache_sql(spark: SparkSession, sql: str | None = None) -> None:
    """Drop one question's result, or all results."""
    keys = list(_CACHE) if sql is None else [_cache_key(spark, spark.sql(sql))]
    for k in keys:
        df = _CACHE.pop(k, None)
        if df is not None:
            df.unpersist()
