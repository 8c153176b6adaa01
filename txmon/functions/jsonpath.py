"""Scalar extraction from JSON text with lax ``JSON_VALUE`` semantics.

``JSON_VALUE(text, '$.x')`` returns the scalar at the path as text, NULL when the path is
missing or when the value is JSON null, an object or an array. ``get_json_object`` differs (it
returns object text), so the rule is built on the variant type: parse once, look at the node's
type, then read it as a string. Texts of any length are kept whole (V2 reports over-long ones).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def parse_json_text(col: Column | str) -> Column:
    """JSON text -> variant, NULL for malformed text (parse each column once, extract many)."""
    return F.try_parse_json(F.col(col) if isinstance(col, str) else col)


def node_scalar(node: Column) -> Column:
    """Text of one variant node; NULL for an object or an array (and for JSON null)."""
    kind = F.schema_of_variant(node)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    return F.when(~nested, F.try_variant_get(node, "$", "string"))


def variant_scalar(v: Column, path: str) -> Column:
    return node_scalar(F.try_variant_get(v, path, "variant"))


def json_scalar(col: Column | str, path: str) -> Column:
    return variant_scalar(parse_json_text(col), path)
