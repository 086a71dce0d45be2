"""Leakage-safe customer features and peer comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import UNITS, units
from ..functions.schema import FEATURE_COLUMNS, HOME_COUNTRY

DAY = 86_400


def add_event_features(df: DataFrame, home: str = HOME_COUNTRY) -> DataFrame:
    """event_date, event_hour, is_night (hours 0 to 5), is_cross_border (null country: 0), log_amount."""
    hour = F.hour("event_time")
    return df.withColumns({
        "event_date": F.to_date("event_time"),
        "event_hour": hour,
        "is_night": hour.between(0, 5).cast("int"),
        "is_cross_border": F.coalesce((F.col("country") != home).cast("int"), F.lit(0)),
        "log_amount": F.log1p("amount"),
    })


#: The rolling measures: column, days, aggregate, what is aggregated (``units``: the amount in whole units).
ROLLING = (
    ("txn_count_24h", 1, F.count, "event_id"),
    ("amount_sum_24h", 1, F.sum, "units"),
    ("amount_avg_7d", 7, F.sum, "units"),
    ("amount_std_30d", 30, F.stddev_pop, "amount"),
    ("cross_border_count_7d", 7, F.sum, "is_cross_border"),
    ("night_txn_count_7d", 7, F.sum, "is_night"),
)


def add_customer_velocity_features(df: DataFrame) -> DataFrame:
    """Rolling measures over whole seconds strictly before an event, 0 where none is; ties in lag go by time and id.

    All frames share one partitioning, hence one shuffle."""
    customer, second = Window.partitionBy("customer_id"), F.col("event_time").cast("long")
    frame = {days: customer.orderBy(second).rangeBetween(-days * DAY, -1) for days in (1, 7, 30)}
    previous = F.lag("event_time").over(customer.orderBy("event_time", "event_id"))
    rolled = {name: f(units() if c == "units" else c).over(frame[days]) for name, days, f, c in ROLLING}
    rolled["amount_sum_24h"] /= UNITS
    rolled["amount_avg_7d"] = rolled["amount_avg_7d"] / F.count("amount").over(frame[7]) / UNITS
    return df.withColumns(rolled | {"previous_transaction_time": previous, "seconds_since_previous_txn": second - previous.cast("long")}).fillna(0, [m[0] for m in ROLLING])


def add_peer_features(df: DataFrame) -> DataFrame:
    """z-score among all events of the day and channel (the event itself and later ones included).

    Day and channel may hold a large share of all rows, so the moments come from a
    partial aggregation joined back rather than from a window over the group."""
    keys = ["event_date", "channel"]
    moments = df.groupBy(*keys).agg(F.avg("amount").alias("peer_amount_mean"), F.stddev_pop("amount").alias("peer_amount_std"))
    right = moments.withColumnsRenamed({k: f"peer_{k}" for k in keys})
    same = F.col("event_date").eqNullSafe(F.col("peer_event_date")) & F.col("channel").eqNullSafe(F.col("peer_channel"))
    z = F.when(F.col("peer_amount_std") > 0, (F.col("amount") - F.col("peer_amount_mean")) / F.col("peer_amount_std")).otherwise(0.0)
    return df.join(right, same, "left").drop(*[f"peer_{k}" for k in keys]).withColumn("amount_peer_zscore", z)


def build_feature_table(df: DataFrame) -> DataFrame:
    return add_peer_features(add_customer_velocity_features(add_event_features(df))).select(*FEATURE_COLUMNS)


def top_scores(features: DataFrame, n: int = 20) -> DataFrame:
    return features.orderBy(F.desc("amount_peer_zscore"), "event_id").limit(n)


def sliding_features(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """The six measures of a customer's sliding windows, batch or stream.

    Merchants are counted exactly; streams don't support count(distinct), so that there
    a window's state holds the set of its different merchants."""
    merchants = F.size(F.collect_set("merchant_id")).cast("long") if df.isStreaming else F.count_distinct("merchant_id")
    got = df.groupBy(F.window("event_time", window, slide), "customer_id").agg(
        F.count("event_id").alias("txn_count_5m"), F.sum("amount").alias("amount_sum_5m"), F.max("amount").alias("amount_max_5m"),
        F.sum("is_cross_border").alias("cross_border_count_5m"), F.sum("is_night").alias("night_count_5m"),
        merchants.alias("merchant_diversity_5m"),
    )
    return got.select("customer_id", *[c for c in got.columns if c.endswith("_5m")], F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
