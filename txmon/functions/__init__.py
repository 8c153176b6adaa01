"""Column-expression helpers. Everything here returns a ``Column`` of built-in Spark
expressions, so callers stay inside whole-stage codegen (no Python UDFs)."""

from txmon.functions.jsonpath import json_scalar, parse_json_text, variant_scalar  # noqa: F401
from txmon.functions.money import expected_fee, format_usd, to_money  # noqa: F401
from txmon.functions.safe import safe_amount, safe_person  # noqa: F401
