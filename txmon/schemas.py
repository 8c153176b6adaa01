"""Canonical record shapes: the raw JSON event and the 24-column flat table."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the nested objects carried by each event.
PERSON_FIELDS = ["name", "address", "account_number", "bank_name", "swift_code"]
METADATA_FIELDS = ["ip_address", "device_id", "user_agent", "channel"]

# Fields of nested parts stay variants until they are flattened, so an object where a scalar is
# expected is still known to be one.
PERSON_SCHEMA = T.StructType([T.StructField(f, T.VariantType()) for f in PERSON_FIELDS])
METADATA_SCHEMA = T.StructType([T.StructField(f, T.VariantType()) for f in METADATA_FIELDS])

RAW_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sender", PERSON_SCHEMA),
    T.StructField("receiver", PERSON_SCHEMA),
    T.StructField("amount_usd", T.DoubleType()),
    T.StructField("sender_country", T.StringType()),
    T.StructField("receiver_country", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("fee_usd", T.DoubleType()),
    T.StructField("reference", T.StringType()),
    T.StructField("metadata", METADATA_SCHEMA),
])

MONEY = T.DecimalType(18, 2)

# The flat table, column order, type and maximum character length
# (None = unlimited). NOT NULL columns are listed in FLAT_NOT_NULL.
FLAT_COLUMNS = [
    ("transaction_id", T.StringType(), 36),
    ("transactiondate", T.TimestampType(), None),
    ("sender_name", T.StringType(), 100),
    ("sender_address", T.StringType(), 255),
    ("sender_account_number", T.StringType(), 50),
    ("sender_bank_name", T.StringType(), 100),
    ("sender_swift_code", T.StringType(), 50),
    ("receiver_name", T.StringType(), 100),
    ("receiver_address", T.StringType(), 255),
    ("receiver_account_number", T.StringType(), 50),
    ("receiver_bank_name", T.StringType(), 100),
    ("receiver_swift_code", T.StringType(), 50),
    ("amount_usd", MONEY, None),
    ("sender_country", T.StringType(), 10),
    ("receiver_country", T.StringType(), 10),
    ("transaction_type", T.StringType(), 50),
    ("status", T.StringType(), 50),
    ("fee_usd", MONEY, None),
    ("reference", T.StringType(), 100),
    ("processing_time", T.TimestampType(), None),
    ("ip_address", T.StringType(), 50),
    ("device_id", T.StringType(), 50),
    ("user_agent", T.StringType(), None),
    ("channel", T.StringType(), 50),
]
FLAT_NOT_NULL = ["transaction_id", "transactiondate", "processing_time"]

FLAT_SCHEMA = T.StructType([T.StructField(n, t, n not in FLAT_NOT_NULL) for n, t, _ in FLAT_COLUMNS])
MAX_LENGTHS = {n: m for n, _, m in FLAT_COLUMNS if m is not None}
