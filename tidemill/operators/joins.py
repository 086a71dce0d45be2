"""Fact to dimension joins and key skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "customer_id"
#: Above this many rows a dimension isn't broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_join(fact: DataFrame, dim: DataFrame, key: str = KEY, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts the dimension if at most ``limit`` rows of it exist; else a co-partitioned join."""
    small = dim.limit(limit + 1).count() <= limit
    return fact.join(F.broadcast(dim), key, "left") if small else copartitioned_join(fact, dim, key)


def copartitioned_join(fact: DataFrame, dim: DataFrame, key: str = KEY, partitions: int = 64) -> DataFrame:
    """Sort-merge join of both sides partitioned by the key."""
    return fact.repartition(partitions, key).join(dim.repartition(partitions, key).hint("merge"), key, "left")


def hot_keys(fact: DataFrame, n: int = 20, key: str = KEY) -> DataFrame:
    """The n most frequent keys and their counts; ties by key."""
    return fact.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)


def salted_join(fact: DataFrame, dim: DataFrame, hot: list[str], buckets: int = 8, key: str = KEY, unique: str = "event_id") -> DataFrame:
    """Spreads the facts of hot keys over ``buckets`` and repeats their dimension rows as often."""
    is_hot = F.col(key).isin(hot)
    left = fact.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(unique), F.lit(buckets))).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    return left.join(dim.withColumn("salt", F.explode(salts)), [key, "salt"], "left").drop("salt")


def segment_stats(joined: DataFrame, accuracy: int = 10_000) -> DataFrame:
    amount = F.col("amount_cents") / 100.0
    return joined.groupBy("segment", "country").agg(
        F.count("event_id").alias("transaction_count"), F.sum(amount).alias("gross_volume"), F.avg(amount).alias("average_ticket"),
        F.percentile_approx(amount, 0.95, accuracy).alias("p95_ticket"),
    )


def explain(df: DataFrame, title: str) -> None:
    print(f"\n{'=' * 90}\n{title}\n{'=' * 90}")
    df.explain(mode="formatted")
