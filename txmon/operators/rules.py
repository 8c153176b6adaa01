"""Fraud rules (F1-F8) and the sanction list as a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmon.functions.money import expected_fee as _expected_fee
from txmon.functions.money import to_money
from txmon.operators.segmented import previous_value

# Default high-amount threshold (USD, inclusive) and sanctioned ISO alpha-3 codes.
HIGH_AMOUNT_THRESHOLD = 1_000_000.0
SANCTIONED_COUNTRIES = ("PRK", "IRN", "SYR", "CUB")


@dataclass(frozen=True)
class RuleConfig:
    high_amount: float = HIGH_AMOUNT_THRESHOLD
    sanctioned: tuple = field(default=SANCTIONED_COUNTRIES)
    amount_col: str = "amount_usd"
    sender_country_col: str = "sender_country"
    receiver_country_col: str = "receiver_country"


def is_high_amount(threshold: float = HIGH_AMOUNT_THRESHOLD, amount_col: str = "amount_usd") -> Column:
    """amount >= threshold; a missing amount and NaN count as 0 (Spark orders NaN above every number)."""
    amount = F.col(amount_col).cast("double")
    return F.coalesce(F.nanvl(amount, F.lit(0.0)), F.lit(0.0)) >= F.lit(float(threshold))


def is_sanctioned(countries=SANCTIONED_COUNTRIES, sender_col: str = "sender_country",
                  receiver_col: str = "receiver_country") -> Column:
    """sender or receiver country in the list (exact match); missing = not sanctioned."""
    lst = list(countries)
    return (F.coalesce(F.col(sender_col).isin(lst), F.lit(False))
            | F.coalesce(F.col(receiver_col).isin(lst), F.lit(False)))


def suspicious_expr(cfg: RuleConfig = RuleConfig()) -> Column:
    return (is_high_amount(cfg.high_amount, cfg.amount_col)
            | is_sanctioned(cfg.sanctioned, cfg.sender_country_col, cfg.receiver_country_col))


def flag_suspicious(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """add ``is_suspicious`` = F1 OR F2 (never NULL)."""
    return df.withColumn("is_suspicious", suspicious_expr(cfg))


# Reason codes, in the order they are listed.
REASON_HIGH_AMOUNT = "HIGH_AMOUNT"
REASON_SANCTIONED_SENDER = "SANCTIONED_SENDER_COUNTRY"
REASON_SANCTIONED_RECEIVER = "SANCTIONED_RECEIVER_COUNTRY"


def without_nulls(arr: Column) -> Column:
    """Drop NULL entries of an array of distinct strings, keeping order. ``array_except`` is
    code-generated (``array_compact`` would evaluate a lambda per element)."""
    return F.array_except(arr, F.array(F.lit(None).cast("string")))


def flag_reasons(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """add ``flag_reasons`` (array of reason codes, empty when not suspicious)."""
    lst = list(cfg.sanctioned)
    reasons = without_nulls(F.array(
        F.when(is_high_amount(cfg.high_amount, cfg.amount_col), F.lit(REASON_HIGH_AMOUNT)),
        F.when(F.coalesce(F.col(cfg.sender_country_col).isin(lst), F.lit(False)), F.lit(REASON_SANCTIONED_SENDER)),
        F.when(F.coalesce(F.col(cfg.receiver_country_col).isin(lst), F.lit(False)), F.lit(REASON_SANCTIONED_RECEIVER)),
    ))
    return df.withColumn("flag_reasons", reasons)


def route(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """add ``route`` = 'suspicious' | 'normal' (each row gets exactly one); a decoded row whose
    message failed to decode gets 'quarantine', whatever the fields that did parse say."""
    r = F.when(suspicious_expr(cfg), F.lit("suspicious")).otherwise(F.lit("normal"))
    if "decode_error" in df.columns:
        r = F.when(F.col("decode_error").isNotNull(), F.lit("quarantine")).otherwise(r)
    return df.withColumn("route", r)


def split_routes(df: DataFrame, cfg: RuleConfig = RuleConfig()) -> tuple[DataFrame, DataFrame]:
    """(suspicious, normal) as two filters of one routed plan; persist the input (or write
    once partitioned by ``route``) when both are consumed."""
    r = route(df, cfg)
    return r.filter(F.col("route") == "suspicious"), r.filter(F.col("route") == "normal")


def flag_dormant(df: DataFrame, account: str, ts: str, amount: str, id_col: str,
                 min_gap_seconds: float, min_amount: float, segment: Column | None = None) -> DataFrame:
    """dormant account with a sudden large transfer.

    Adds ``prev_ts`` (the account's previous transaction, ordered by ``(ts, id)``),
    ``gap_seconds`` and ``is_dormant_burst`` = previous exists, gap >= min gap and
    amount >= min amount. The lag is computed skew-safe (see ``segmented``).
    """
    with_prev = previous_value(df, [account], [ts, id_col], ts, "prev_ts", segment)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))) / F.lit(1e6)
    return (with_prev.withColumn("gap_seconds", gap)
            .withColumn("is_dormant_burst",
                        F.coalesce((F.col("gap_seconds") >= F.lit(float(min_gap_seconds)))
                                   & (F.col(amount).cast("double") >= F.lit(float(min_amount))), F.lit(False))))


def expected_fee(df: DataFrame, amount_col: str = "amount_usd", out: str = "expected_fee") -> DataFrame:
    """min(5 + 1 % of amount, 50), rounded to cents."""
    return df.withColumn(out, _expected_fee(amount_col))


def fee_audit(df: DataFrame, amount_col: str = "amount_usd", fee_col: str = "fee_usd",
              tol: float = 0.01) -> DataFrame:
    """F8: rows whose charged fee differs from the rule by more than ``tol``."""
    e = expected_fee(df, amount_col)
    diff = to_money(fee_col) - F.col("expected_fee")
    return (e.withColumn("fee_diff", diff)
             .filter(F.coalesce(F.abs(F.col("fee_diff")) > F.lit(tol), F.col(fee_col).isNull())))


def mark_sanctioned_by_table(df: DataFrame, countries: DataFrame, code_col: str = "country",
                             sender_col: str = "sender_country", receiver_col: str = "receiver_country") -> DataFrame:
    """Sanction list held as a table. Two left joins on the distinct codes mark each side.

    The list is de-duplicated first, so the joins never multiply rows; whether it is broadcast
    is left to the planner's size check (AQE converts it when its runtime size is small).
    """
    codes = countries.select(F.col(code_col).alias("_code")).distinct()
    s = codes.select(F.col("_code").alias("_s_code"))
    r = codes.select(F.col("_code").alias("_r_code"))
    out = (df.join(s, F.col(sender_col) == F.col("_s_code"), "left")
             .join(r, F.col(receiver_col) == F.col("_r_code"), "left"))
    return (out.withColumn("sanctioned_sender", F.col("_s_code").isNotNull())
               .withColumn("sanctioned_receiver", F.col("_r_code").isNotNull())
               .withColumn("is_sanctioned", F.col("sanctioned_sender") | F.col("sanctioned_receiver"))
               .drop("_s_code", "_r_code"))
