"""Schemas and domain values of transaction events."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the data contract.
COUNTRIES = ("TR", "DE", "NL", "GB", "US", "JP")
CHANNELS = ("card", "bank_transfer", "wallet", "atm")
CURRENCIES = ("TRY", "EUR", "USD", "GBP")
REQUIRED = ("event_id", "customer_id", "event_time", "amount", "currency", "merchant_id")
OPTIONAL = ("country", "channel")
HOME_COUNTRY = "TR"

TRANSACTION = T.StructType(
    [
        T.StructField(name, T.TimestampType() if name == "event_time" else T.DoubleType() if name == "amount" else T.StringType())
        for name in ("event_id", "customer_id", "merchant_id", "event_time", "amount", "currency", "channel", "country")
    ]
)
SILVER = T.StructType([*TRANSACTION.fields, T.StructField("payload_sha256", T.StringType()), T.StructField("ingestion_run_id", T.StringType()), T.StructField("event_date", T.DateType())])
CUSTOMER = T.StructType([T.StructField(n, T.StringType()) for n in ("customer_id", "segment", "country")])
MINIMAL = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("customer_id", T.StringType()), T.StructField("amount_cents", T.IntegerType())])
CANDIDATE = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "payload_sha256", "event_date")])
EVENT_LEDGER = T.StructType([*CANDIDATE.fields, T.StructField("run_id", T.StringType())])
CONFLICT = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "existing_sha256", "incoming_sha256", "incoming_run_id")])
FEATURE_COLUMNS = (
    "event_id", "customer_id", "event_time", "amount", "channel", "country", "log_amount", "is_night", "is_cross_border",
    "txn_count_24h", "amount_sum_24h", "amount_avg_7d", "amount_std_30d", "cross_border_count_7d", "night_txn_count_7d",
    "seconds_since_previous_txn", "amount_peer_zscore",
)
