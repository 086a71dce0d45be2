"""SQL marts: facts, daily activity, velocity, daily risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import UNITS, half_up, units

FACT = ("event_id", "customer_id", "event_time", "amount", "currency", "merchant_id", "country", "channel", "event_date", "ingestion_run_id")


def fact_transactions(silver: DataFrame) -> DataFrame:
    kinds = {"event_time": "timestamp", "amount": "double", "event_date": "date"}
    return silver.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FACT])


def customer_daily_activity(fact: DataFrame, transfer: str = "bank_transfer") -> DataFrame:
    total = F.sum(units())
    return fact.groupBy("customer_id", "event_date").agg(
        F.count(F.lit(1)).alias("transaction_count"), half_up(total / UNITS, 2).alias("gross_amount"), half_up(total / F.count("amount") / UNITS, 2).alias("average_amount"),
        F.countDistinct("merchant_id").alias("merchant_count"), F.countDistinct("country").alias("country_count"),
        F.count_if(F.col("channel") == transfer).alias("transfer_count"),
    )


def high_velocity_customers(daily: DataFrame, transactions: int = 10, countries: int = 3, gross: float = 5000) -> DataFrame:
    """Ordered by gross amount where it is consumed, as a view has no order of its own."""
    return daily.filter((F.col("transaction_count") >= transactions) | (F.col("country_count") >= countries) | (F.col("gross_amount") >= gross))


def customer_daily_risk(staged: DataFrame, atm: str = "atm") -> DataFrame:
    """Daily measures, and averages over the customer's last 7 and 30 *active* days."""
    total = F.sum(units())
    base = staged.groupBy("customer_id", F.date_trunc("day", "event_time").alias("event_date")).agg(
        F.count(F.lit(1)).alias("transaction_count"), (total / UNITS).alias("total_amount"), (total / F.count("amount") / UNITS).alias("average_amount"), total.alias("units"), F.max("amount").alias("max_amount"),
        F.countDistinct("merchant_id").alias("unique_merchants"), F.count_if(F.col("channel") == atm).alias("atm_transactions"),
    )
    by = Window.partitionBy("customer_id").orderBy("event_date")
    week, month = by.rowsBetween(-6, 0), by.rowsBetween(-29, 0)
    spend = F.sum("units").over(week) / F.count("units").over(week) / UNITS
    return base.withColumns({"rolling_7d_spend": spend, "rolling_30d_txn_count": F.avg("transaction_count").over(month)}).drop("units")


def build_marts(silver: DataFrame, prefix: str = "") -> dict[str, int]:
    """Writes the two tables, creates the view, returns their row counts."""
    spark: SparkSession = silver.sparkSession
    fact_transactions(silver).write.mode("overwrite").saveAsTable(f"{prefix}fact_transactions")
    fact = spark.table(f"{prefix}fact_transactions")
    customer_daily_activity(fact).write.mode("overwrite").saveAsTable(f"{prefix}customer_daily_activity")
    daily = spark.table(f"{prefix}customer_daily_activity")
    high_velocity_customers(daily).createOrReplaceTempView(f"{prefix}high_velocity_customers")
    customer_daily_risk(fact).write.mode("overwrite").saveAsTable(f"{prefix}customer_daily_risk")
    return {n: spark.table(prefix + n).count() for n in ("fact_transactions", "customer_daily_activity", "high_velocity_customers", "customer_daily_risk")}


def export_rows(daily: DataFrame) -> DataFrame:
    return daily.orderBy("event_date", "customer_id")
