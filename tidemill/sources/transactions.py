"""Sources of transaction events."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of the non-blank lines.  Numbers ascend in the order of the file;
    they are consecutive where the file is read as one split."""
    lines = spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("line_no"), F.trim("value").alias("raw"))
    return lines.filter(F.col("raw") != "")


def silver(spark: SparkSession, root: str, runs: list[str] | None = None, days: tuple[str, str] | None = None) -> DataFrame:
    """Silver events; of the given runs, and of days first..last by partition pruning.  The
    environment's SILVER_GLOB replaces the root."""
    path = os.environ.get("SILVER_GLOB") or root
    base = "/".join(itertools.takewhile(lambda part: not set(part) & set("*?[{"), path.split("/")))
    df = spark.read.schema(schema.SILVER).option("basePath", base).parquet(path)
    if runs is not None:
        df = df.filter(F.col("ingestion_run_id").isin(runs))
    return df.filter(F.col("event_date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date"))) if days else df


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of non-negative amount, one for each event_id."""
    from ..operators.resolve import dedup_events

    df = spark.read.schema(schema.TRANSACTION).parquet(path).filter(F.col("amount") >= 0)
    return dedup_events(df, ["event_time", "amount", "customer_id"])


def minimal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MINIMAL).parquet(path)


def customers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CUSTOMER).parquet(path)


def generate(spark: SparkSession, count: int, seed: int = 42, start: str = "2026-08-01T00:00:00Z", partitions: int | None = None) -> DataFrame:
    """Deterministic events: gaps of 1 to 90 seconds, weighted channels, currencies and
    countries, log-normal amounts of at least 1.  Values follow from id and seed, however
    the range is partitioned; gaps are averaged out so that no global sum is needed."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / (1 << 40)

    def pick(k: str, weights: dict):
        total, at, out = sum(weights.values()), 0.0, None
        for v, w in weights.items():
            at += w / total
            out = F.when(u(k) <= at, v) if out is None else out.when(u(k) <= at, v)
        return out.otherwise(list(weights)[-1])

    channel = pick("channel", {"card": 0.62, "bank_transfer": 0.16, "wallet": 0.17, "atm": 0.05})
    base = F.when(F.col("channel") == "card", 95).when(F.col("channel") == "bank_transfer", 850).when(F.col("channel") == "wallet", 55).otherwise(280)
    normal = F.sqrt(-2 * F.log(u("n1"))) * F.cos(2 * F.pi() * u("n2"))
    seconds = F.floor(F.col("id") * 45.5 + u("gap") * 44).cast("long")
    ids = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    return ids.withColumn("channel", channel).select(
        F.concat(F.lit("evt-"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("-"), F.substring(F.sha2(F.concat_ws("/", "id", F.lit(seed)), 256), 1, 12)).alias("event_id"),
        F.concat(F.lit("cust-"), F.lpad((1 + F.floor(u("customer") * max(20, count // 25))).cast("string"), 6, "0")).alias("customer_id"),
        F.concat(F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("event_time"),
        F.greatest(F.round(base * F.exp(0.9 * normal), 2), F.lit(1.0)).alias("amount"),
        pick("currency", {"TRY": 0.7, "EUR": 0.15, "USD": 0.1, "GBP": 0.05}).alias("currency"),
        F.concat(F.lit("merchant-"), F.lpad((1 + F.floor(u("merchant") * 250)).cast("string"), 4, "0")).alias("merchant_id"),
        pick("country", {"TR": 0.8, "DE": 0.06, "NL": 0.04, "GB": 0.04, "US": 0.04, "JP": 0.02}).alias("country"),
        "channel",
    )


def from_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as transactions."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    home = F.array(*map(F.lit, schema.COUNTRIES))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("customer_id"), F.concat(F.lit("m"), k.cast("string")).alias("merchant_id"),
        F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("amount"), F.lit("TRY").alias("currency"), F.col("event_type").alias("channel"), F.get(home, F.pmod(k, F.lit(6))).alias("country"),
    )
