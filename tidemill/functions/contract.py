"""The event contract as column expressions over raw JSON text.

Extra care over plain JSON-schema validation: patterns are anchored at the very
end of a value, numbers must be finite, and a zone is required in event_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import CHANNELS, OPTIONAL, REQUIRED

_STRINGS = {"event_id": 8, "customer_id": 1, "merchant_id": 1}
_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with ``event``: the JSON text parsed once.  It holds the variant, the keys of an
    object (null for anything else), and each known field's kind and text.

    The parse and the field lookups are projections of their own: Catalyst doesn't merge
    projections whose costly columns are used several times, so no rule parses again."""
    known = (*REQUIRED, *OPTIONAL)
    out = df.withColumn("event", F.struct(F.try_parse_json(raw).alias("v"), F.json_object_keys(raw).alias("keys")))
    out = out.withColumn("event", F.struct("event.v", "event.keys", *[F.try_variant_get("event.v", f"$.{f}", "variant").alias(f) for f in known]))
    pair = lambda f: F.struct(F.schema_of_variant(F.col("event")[f]).alias("kind"), F.try_variant_get(F.col("event")[f], "$", "string").alias("text")).alias(f)
    return out.withColumn("event", F.struct("event.v", "event.keys", *[pair(f) for f in known]))


def value(name: str) -> Column:
    """A known field's text, null if it is absent or can't be cast."""
    return F.col("event")[name]["text"]


def contract_errors() -> Column:
    """Sorted error codes of a parsed event; empty if it is valid."""
    keys, v = F.col("event.keys"), F.col("event.v")
    kind = lambda f: F.col("event")[f]["kind"]
    is_text = lambda f: kind(f) == "STRING"
    number = kind("amount").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    amount = value("amount").try_cast("double")
    rules = [(~F.array_contains(keys, f), f"missing:{f}") for f in REQUIRED]
    rules += [(F.array_contains(keys, f) & ~F.coalesce(number if f == "amount" else is_text(f), F.lit(False)), f"type:{f}") for f in (*REQUIRED, *OPTIONAL)]
    rules += [(is_text(f) & (F.char_length(value(f)) < n), f"min_length:{f}") for f, n in _STRINGS.items()]
    rules += [
        (is_text("event_time") & ~(value("event_time").rlike(_TIME) & value("event_time").try_cast("timestamp").isNotNull()), "format:event_time"),
        (number & (F.isnan(amount) | (F.abs(amount) == float("inf"))), "finite:amount"),
        (number & (amount < 0), "minimum:amount"),
        (is_text("currency") & ~value("currency").rlike(r"^[A-Z]{3}\z"), "pattern:currency"),
        (is_text("country") & ~value("country").rlike(r"^[A-Z]{2}\z"), "pattern:country"),
        (is_text("channel") & ~value("channel").isin(*CHANNELS), "enum:channel"),
    ]
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, (*REQUIRED, *OPTIONAL)))), lambda k: F.concat(F.lit("unexpected:"), k))
    found = F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))
    return (
        F.when(v.isNull() & keys.isNull(), F.array(F.lit("json:invalid")))
        .when(keys.isNull(), F.array(F.lit("json:not_an_object")))
        .when(v.isNull(), F.array(F.lit("json:duplicate_key")))
        .otherwise(F.array_sort(F.concat(found, extra)))
    )


def checked(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with the error codes of its JSON texts."""
    return parsed(df, raw).withColumn("errors", contract_errors()).drop("event")


def payload_digest(raw: Column | None = None) -> Column:
    """SHA-256 of the event with sorted keys; 10 and 10.0 are one value.  Of a parsed event, or of JSON text."""
    return F.sha2(F.to_json(F.col("event.v") if raw is None else F.try_parse_json(raw)), 256)


def stream_error(prefix: str = "") -> Column:
    """The first of six failures of a typed event, null if it is valid."""
    c = lambda n: F.col(prefix + n)
    return (
        F.when(c("event_id").isNull(), F.lit("missing_event_id"))
        .when(c("customer_id").isNull(), F.lit("missing_customer_id"))
        .when(c("event_time").isNull(), F.lit("missing_event_time"))
        .when(c("amount").isNull(), F.lit("missing_amount"))
        .when(c("amount") < 0, F.lit("negative_amount"))
        .when(c("currency").isNull(), F.lit("missing_currency"))
    )
