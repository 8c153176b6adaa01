"""Money helpers: amounts are DECIMAL(18,2); the fee rule and the alert number format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txmon.schemas import MONEY

# Fixed values of the fee rule: base fee, rate on the amount, cap.
FEE_BASE = "5"
FEE_RATE = "0.01"
FEE_CAP = "50"


def to_money(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def expected_fee(amount: Column | str) -> Column:
    """min(5 + 1 % of amount, 50) rounded to cents, computed in decimal (HALF_UP)."""
    a = to_money(amount)
    raw = F.least(F.lit(FEE_BASE).cast("decimal(3,0)") + a * F.lit(FEE_RATE).cast("decimal(3,2)"),
                  F.lit(FEE_CAP).cast("decimal(3,0)"))
    return F.round(raw, 2).cast(MONEY)


def format_usd(col: Column | str) -> Column:
    """``$1,234.56`` (thousands separators, two decimals)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))
