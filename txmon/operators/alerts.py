"""Alert records for suspicious rows (P4-P6) and run tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmon.functions.money import format_usd
from txmon.functions.jsonpath import parse_json_text
from txmon.functions.safe import NA, safe_amount, safe_person

# Alert text layout. Bank/SWIFT/account lines appear only above the detail
# threshold (strictly greater) and only for person cells that parse to an object (or fall back).
ALERT_HEADER = ":rotating_light: *NEW SUSPICIOUS TRANSACTION DETECTED* :rotating_light:\n\n"
DETAIL_THRESHOLD = 1_000_000.0


def _txt(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NA))


def _details(p: Column, amount: Column, threshold: float) -> Column:
    lines = F.concat(F.lit("• *Bank:* "), p["bank_name"], F.lit("\n"),
                     F.lit("• *SWIFT:* "), p["swift_code"], F.lit("\n"),
                     F.lit("• *Account:* "), p["account_number"], F.lit("\n"))
    show = (amount > F.lit(threshold)) & p["kind"].isin("object", "fallback")
    return F.when(show, lines).otherwise(F.lit(""))


def alert_messages(df: DataFrame, file_col: str = "source_file",
                   detail_threshold: float = DETAIL_THRESHOLD) -> DataFrame:
    """One alert text per row, built from column expressions (no UDF).

    Adds ``sender_name``, ``receiver_name``, ``amount``, ``fee`` and ``message``.
    """
    # parse each person cell once; the struct fields then read the parsed variant
    d = df.withColumns({"_sv": parse_json_text(F.col("sender")), "_rv": parse_json_text(F.col("receiver"))})
    d = d.withColumns({"_s": safe_person("sender", F.col("_sv")), "_r": safe_person("receiver", F.col("_rv")),
                       "amount": safe_amount("amount_usd"), "fee": safe_amount("fee_usd")}).drop("_sv", "_rv")
    msg = F.concat(
        F.lit(ALERT_HEADER),
        F.lit("*File Path:*\n"), _txt(file_col), F.lit("\n\n"),
        F.lit("*Transaction Details*\n"),
        F.lit("• *ID:* "), _txt("transaction_id"), F.lit("\n"),
        F.lit("• *Amount:* "), format_usd(F.col("amount")), F.lit(" USD\n"),
        F.lit("• *Fee:* "), format_usd(F.col("fee")), F.lit(" USD\n\n"),
        F.lit("*Sender Information*\n"),
        F.lit("• *Name:* "), F.col("_s.name"), F.lit("\n"),
        _details(F.col("_s"), F.col("amount"), detail_threshold),
        F.lit("• *Country:* "), _txt("sender_country"), F.lit("\n\n"),
        F.lit("*Receiver Information*\n"),
        F.lit("• *Name:* "), F.col("_r.name"), F.lit("\n"),
        _details(F.col("_r"), F.col("amount"), detail_threshold),
        F.lit("• *Country:* "), _txt("receiver_country"), F.lit("\n\n"),
        F.lit("*Additional Information*\n"),
        F.lit("• *Transaction Type:* "), _txt("transaction_type"), F.lit("\n"),
        F.lit("• *Status:* "), _txt("status"), F.lit("\n"),
        F.lit("• *Timestamp:* "), _txt("timestamp"))
    return (d.withColumn("message", msg)
             .withColumn("sender_name", F.col("_s.name")).withColumn("receiver_name", F.col("_r.name"))
             .drop("_s", "_r"))


# Fixed value: head of an error alert.
ERROR_HEADER = ":x: *ERROR PROCESSING FILE*\n"


def error_message(file_col: str = "source_file", error_col: str = "decode_error") -> Column:
    """T5: the alert of a row that could not be processed."""
    return F.concat(F.lit(ERROR_HEADER), F.lit("File: "), _txt(file_col), F.lit("\nError: "), _txt(error_col))


def run_metrics(df: DataFrame, by: str = "source_file", error: Column | None = None,
                suspicious: Column | None = None) -> DataFrame:
    """Per file (or batch): processed rows, error rows, suspicious and normal rows."""
    err = error if error is not None else (F.col("decode_error").isNotNull() if "decode_error" in df.columns
                                           else F.col("transaction_id").isNull())
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(err).alias("n_errors"),
            F.count_if(~err).alias("n_processed")]
    if suspicious is not None:
        aggs += [F.count_if(suspicious).alias("n_suspicious"), F.count_if(~suspicious).alias("n_normal")]
    return df.groupBy(by).agg(*aggs)
