"""The hourly and the daily pipeline as lists of stages for ``runner.run_stages``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import contract
from ..operators import features, marts, quality
from ..sources import sinks, transactions
from ..sources.files import Files
from .ingest import Stats, committed_silver, ingest


class Rejected(RuntimeError):
    """Events were invalid or in conflict, or a table breaks a rule."""


def _incoming(spark: SparkSession, root: str) -> list[str]:
    return Files(spark).walk(f"{root}/incoming/transactions", ".json")


def _generate(spark: SparkSession, root: str, count: int, seed: int) -> int:
    sinks.write_jsonl(transactions.generate(spark, count, seed), f"{root}/incoming/transactions")
    return count


def _ingest(spark: SparkSession, root: str) -> list[Stats]:
    """Every incoming file as a batch of its own; what was ingested before writes nothing."""
    done = [ingest(spark, path, root) for path in _incoming(spark, root)]
    bad = sum(s.invalid + s.conflicts for s in done)
    if bad:
        raise Rejected(f"{bad} events are invalid or in conflict")
    return done


def _validate(spark: SparkSession, root: str) -> int:
    """The contract over the raw events; returns how many were read."""
    got = [contract.checked(transactions.jsonl(spark, path)).agg(F.count(F.lit(1)), F.count_if(F.size("errors") > 0)).first() for path in _incoming(spark, root)]
    if bad := sum(r[1] for r in got):
        raise Rejected(f"{bad} events are invalid")
    return sum(r[0] for r in got)


def _marts(spark: SparkSession, root: str) -> dict[str, int]:
    return marts.build_marts(committed_silver(spark, root))


def _features(spark: SparkSession, root: str) -> int:
    table = features.build_feature_table(committed_silver(spark, root).filter("amount >= 0"))
    sinks.write_features(table, f"{root}/features/transactions")
    return spark.read.parquet(f"{root}/features/transactions").count()


def _quality(spark: SparkSession, root: str) -> list[str]:
    fact = marts.fact_transactions(committed_silver(spark, root))
    tables = {"stg_transactions": fact, "customer_daily_activity": marts.customer_daily_activity(fact), "customer_daily_risk": marts.customer_daily_risk(fact)}
    found = [f for name, table in tables.items() for f in quality.failures(name, table)]
    if found:
        raise Rejected(", ".join(found))
    return found


def hourly(spark: SparkSession, root: str, count: int = 10_000, seed: int = 42) -> list:
    """generate, contract to silver, marts, quality."""
    return [("generate", lambda: _generate(spark, root, count, seed)), ("contract_to_silver", lambda: _ingest(spark, root)), ("marts", lambda: _marts(spark, root)), ("quality", lambda: _quality(spark, root))]


def daily(spark: SparkSession, root: str) -> list:
    """validate the raw events, marts and features, quality."""
    return [("validate", lambda: _validate(spark, root)), ("marts", lambda: _marts(spark, root)), ("features", lambda: _features(spark, root)), ("quality", lambda: _quality(spark, root))]
