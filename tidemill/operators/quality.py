"""Assertions over tables: rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that hold no null in each table, and its unique keys (fixed values).
NOT_NULL = {"stg_transactions": ("event_id", "customer_id", "event_time", "amount", "currency"), "customer_daily_activity": ("customer_id", "event_date", "transaction_count"), "customer_daily_risk": ("customer_id", "event_date")}
UNIQUE = {"stg_transactions": ("event_id",), "customer_daily_activity": ("customer_id", "event_date"), "customer_daily_risk": ("customer_id", "event_date")}


def null_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: the nulls in each column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def repeated_keys(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows without their parent."""
    return child.join(parent, key, "left_anti")


def failures(name: str, df: DataFrame) -> list[str]:
    """Names of the rules that the table breaks."""
    found = null_counts(df, NOT_NULL[name]).first().asDict()
    out = [f"not_null:{name}.{c}" for c, n in found.items() if n]
    if repeated_keys(df, UNIQUE[name]).limit(1).count():
        out.append(f"unique:{name}.{','.join(UNIQUE[name])}")
    return out
