"""Deduplication and classification of events against their batch and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract


def dedup_events(df: DataFrame, order: list[Column | str], key: str = "event_id") -> DataFrame:
    """The first row of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def classify_batch(lines: DataFrame) -> DataFrame:
    """Lines (line_no, raw) with event_id, event_date, payload_sha256, errors and status.

    The first *valid* row of an id is its candidate; later ones are duplicates or,
    with another payload, conflicts.  Invalid rows claim no id."""
    day = F.to_date(contract.value("event_time").try_cast("timestamp")).cast("string")
    rows = contract.parsed(lines).withColumns({"errors": contract.contract_errors(), "event_id": contract.value("event_id"), "event_date": day, "payload_sha256": contract.payload_digest()}).drop("event")
    rows = rows.withColumn("valid", F.size("errors") == 0)
    # invalid rows are spread by line, so that one id can't gather them
    group = F.when(F.col("valid"), F.col("event_id")).otherwise(F.concat(F.lit("\u0000"), F.col("line_no").cast("string")))
    first = Window.partitionBy(group).orderBy("line_no")
    rows = rows.withColumns({"rank": F.row_number().over(first), "first_sha256": F.first("payload_sha256").over(first)})
    status = F.when(~F.col("valid"), "invalid").when(F.col("rank") == 1, "candidate").when(F.col("payload_sha256") == F.col("first_sha256"), "duplicate").otherwise("conflict")
    errors = F.when(status == "conflict", F.array(F.lit("in_batch_event_id_payload_conflict"))).otherwise(F.col("errors"))
    return rows.withColumns({"status": status, "errors": errors}).drop("valid", "rank", "first_sha256")


def classify_ledger(candidates: DataFrame, ledger: DataFrame, run_id: str) -> DataFrame:
    """Candidates with their standing against the ledger (event_id, payload_sha256, run_id, state):
    accept, conflict, reserved_elsewhere or duplicate; a conflict comes before the owner."""
    known = ledger.select("event_id", F.col("payload_sha256").alias("existing_sha256"), F.col("run_id").alias("owner"), "state")
    standing = (
        F.when(F.col("existing_sha256").isNull(), "accept")
        .when(F.col("existing_sha256") != F.col("payload_sha256"), "conflict")
        .when((F.col("state") == "reserved") & (F.col("owner") != run_id), "reserved_elsewhere")
        .when(F.col("state") == "reserved", "accept")
        .otherwise("duplicate")
    )
    return candidates.join(known, "event_id", "left").withColumn("standing", standing)


def unseen(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(ledger, "event_id", "left_anti")


def seen(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(ledger, "event_id", "left_semi")


def run_counters(classified: DataFrame) -> DataFrame:
    """received, valid, invalid, duplicates and conflicts of a batch."""
    of = lambda s: F.count_if(F.col("status") == s)
    return classified.agg(F.count(F.lit(1)).alias("received"), of("candidate").alias("valid"), of("invalid").alias("invalid"), of("duplicate").alias("duplicates"), of("conflict").alias("conflicts"))
