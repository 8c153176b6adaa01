"""Stream projection (P1), flatten (P2), conform to the flat table (P3) and validation (V1, V2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txmon.functions.jsonpath import node_scalar
from txmon.operators.rules import without_nulls
from txmon.schemas import FLAT_COLUMNS, FLAT_NOT_NULL, MAX_LENGTHS, METADATA_FIELDS, PERSON_FIELDS


def project_stream(df: DataFrame, nested_as_text: bool = True) -> DataFrame:
    """13-column projection of decoded events, ingest time kept as ``Processingtime``.

    Nested parts become JSON text, as in the relational raw table. A pipeline that flattens
    right away passes ``nested_as_text=False`` and keeps the decoded structs, so ``flatten``
    reads their fields directly instead of re-serialising and re-parsing the JSON."""
    def as_text(name: str) -> Column:
        c = F.col(name)
        if not nested_as_text or isinstance(df.schema[name].dataType, T.StringType):
            return c
        return F.to_json(c)

    ingest = F.col("ingest_time") if "ingest_time" in df.columns else F.current_timestamp()
    return df.select(
        "transaction_id",
        F.try_to_timestamp(F.col("timestamp")).alias("transactiondate"),
        as_text("sender").alias("sender"),
        as_text("receiver").alias("receiver"),
        "amount_usd", "sender_country", "receiver_country", "transaction_type", "status",
        "fee_usd", "reference",
        as_text("metadata").alias("metadata"),
        ingest.alias("Processingtime"),
    )


def _nested(df: DataFrame, name: str, fields: list[str], prefix: str) -> list[Column]:
    """Scalar fields of a nested part: one rule for decoded structs and for parsed JSON text."""
    have = {f.name: f.dataType for f in df.schema[name].dataType.fields}
    out = []
    for f in fields:
        if f not in have:
            c = F.lit(None).cast("string")
        elif isinstance(have[f], T.VariantType):
            c = node_scalar(F.col(name)[f])
        else:
            c = F.col(name)[f].cast("string")
        out.append(c.alias(f"{prefix}{f}"))
    return out


def _parsed(df: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """JSON text columns replaced by structs of variants, parsed once in a projection of their own."""
    text = {n: T.StructType([T.StructField(f, T.VariantType()) for f in fields])
            for n, fields in parts.items() if not isinstance(df.schema[n].dataType, T.StructType)}
    return df.withColumns({n: F.from_json(F.col(n).cast("string"), s) for n, s in text.items()}) if text else df


def flatten(df: DataFrame) -> DataFrame:
    """24 flat columns from the projected row (``sender``/``receiver``/``metadata`` may be JSON
    text, with lax JSON_VALUE semantics, or structs)."""
    ptime = "Processingtime" if "Processingtime" in df.columns else "processing_time"
    df = _parsed(df, {"sender": PERSON_FIELDS, "receiver": PERSON_FIELDS, "metadata": METADATA_FIELDS})
    sender = _nested(df, "sender", PERSON_FIELDS, "sender_")
    receiver = _nested(df, "receiver", PERSON_FIELDS, "receiver_")
    meta = _nested(df, "metadata", METADATA_FIELDS, "")
    return df.select(
        "transaction_id", "transactiondate", *sender, *receiver,
        "amount_usd", "sender_country", "receiver_country", "transaction_type", "status",
        "fee_usd", "reference", F.col(ptime).alias("processing_time"), *meta,
    )


def conform_flat(df: DataFrame) -> DataFrame:
    """Cast to the flat table's types; values that do not convert become NULL (try_cast)."""
    out = []
    for name, dtype, _ in FLAT_COLUMNS:
        c = F.col(name)
        if isinstance(dtype, T.TimestampType):
            src = df.schema[name].dataType
            c = F.try_to_timestamp(c) if isinstance(src, T.StringType) else c.cast("timestamp")
        else:
            c = c.try_cast(dtype)
        out.append(c.alias(name))
    return df.select(*out)


def validate(df: DataFrame, max_lengths: dict | None = None, not_null=FLAT_NOT_NULL) -> DataFrame:
    """Add ``reject_reasons`` (array of text): NOT NULL violations (V1) and over-long text (V2)."""
    limits = MAX_LENGTHS if max_lengths is None else max_lengths
    checks = [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in not_null if c in df.columns]
    checks += [F.when(F.length(F.col(c)) > n, F.lit(f"too_long:{c}"))
               for c, n in limits.items() if c in df.columns]
    if not checks:
        return df.withColumn("reject_reasons", F.array().cast("array<string>"))
    return df.withColumn("reject_reasons", without_nulls(F.array(*checks)))


def split_valid(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(good, bad): one validated plan filtered two ways. Persist or write once with a
    partition column when both sides are consumed, so the input is scanned a single time."""
    v = validate(df, **kw)
    good = v.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    bad = v.filter(F.size("reject_reasons") > 0)
    return good, bad
