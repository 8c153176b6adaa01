"""Tolerant parsing used by the alert path (text read back from CSV files)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txmon.functions.jsonpath import parse_json_text

# Fixed value: default text for a missing value.
NA = "N/A"


def safe_amount(col: Column | str) -> Column:
    """Number from text or number; anything non-numeric becomes 0 (also '5d' and '7f', which the
    JVM's cast would read as numbers)."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    number = F.when(~text.rlike(r"(?i)[0-9.][df]\s*$"), text.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def _field(v: Column, name: str) -> Column:
    # dict.get(name, 'N/A'): missing key -> N/A; JSON null prints as "None".
    node = F.try_variant_get(v, f"$.{name}", "variant")
    return (F.when(node.isNull(), F.lit(NA))
            .when(F.is_variant_null(node), F.lit("None"))
            .otherwise(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.to_json(node))))


def safe_person(col: Column | str, parsed: Column | None = None) -> Column:
    """Person cell (JSON text) -> struct(kind, name, bank_name, swift_code, account_number).

    kind: ``na`` for NULL / empty / 'N/A' text, ``object`` for a JSON object, ``fallback``
    for unparsable text (the whole text becomes the name, other fields N/A) and ``other``
    for valid JSON that is not an object. Fields are 'N/A' unless kind is object/fallback.
    Pass ``parsed`` (a column holding ``parse_json_text(col)``) to parse the text only once.
    """
    c = F.col(col) if isinstance(col, str) else col
    v = parsed if parsed is not None else parse_json_text(c)
    is_na = c.isNull() | (c == "") | (c == NA)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    kind = (F.when(is_na, F.lit("na")).when(v.isNull(), F.lit("fallback"))
            .when(is_obj, F.lit("object")).otherwise(F.lit("other")))

    def pick(name: str) -> Column:
        obj_val = _field(v, name)
        fb_val = c if name == "name" else F.lit(NA)
        return (F.when(kind == "object", obj_val).when(kind == "fallback", fb_val)
                .otherwise(F.lit(NA)))

    return F.struct(kind.alias("kind"), pick("name").alias("name"),
                    pick("bank_name").alias("bank_name"), pick("swift_code").alias("swift_code"),
                    pick("account_number").alias("account_number"))
