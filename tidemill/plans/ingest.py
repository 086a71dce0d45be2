"""Replay-safe ingestion of a JSON-lines file into bronze, silver and quarantine.

Silver and quarantine are published before the ledger commits; readers take only
committed runs, so what a crashed run left behind is invisible until its retry
replaces it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contract
from ..functions.schema import SILVER, TRANSACTION
from ..operators.resolve import classify_batch, run_counters
from ..sources import transactions
from ..sources.files import Files
from .ledger import Ledger


@dataclass(frozen=True)
class Stats:
    run_id: str
    attempt: int
    received: int
    valid: int
    invalid: int
    duplicates: int
    conflicts: int
    written: int
    replayed_run: bool
    bronze_path: str
    silver_path: str
    quarantine_path: str
    manifest_path: str


def typed(rows: DataFrame, run_id: str) -> DataFrame:
    fields = [contract.value(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTION]
    out = contract.parsed(rows).select(*fields, "payload_sha256", F.lit(run_id).alias("ingestion_run_id"))
    return out.withColumn("event_date", F.to_date("event_time"))


def ingest(spark: SparkSession, path: str, root: str) -> Stats:
    files, ledger = Files(spark), Ledger(spark, f"{root}/metadata")
    digest = files.sha256(path)
    run_id = digest[:20]
    bronze, silver, quarantine = (f"{root}/{x}/transactions" for x in ("bronze", "silver", "quarantine"))
    bronze_path = f"{bronze}/run={run_id}.jsonl"
    if not files.exists(bronze_path):
        files.copy(path, bronze_path)
    batch = classify_batch(transactions.jsonl(spark, bronze_path)).persist()
    try:
        n = run_counters(batch).first()
        chosen = batch.filter("status = 'candidate'")
        held = ledger.reserve(run_id, digest, n["received"], chosen.select("event_id", "payload_sha256", "event_date"))
        try:
            if not held.replayed_run:
                if held.n_accepted:
                    rows = typed(chosen.join(held.accepted, "event_id", "left_semi"), run_id)
                    # a run's rows of a day are its own files: a retry replaces them, other runs stay
                    rows.withColumn("run", F.lit(run_id)).hint("rebalance", "event_date").write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("event_date", "run").parquet(silver)
                bad = batch.filter("status in ('invalid', 'conflict')").select("line_no", "raw", "errors")
                if held.conflicts:
                    against = chosen.join(held.conflicting, "event_id", "left_semi").select("line_no", "raw", F.array(F.lit("event_id_payload_conflict")).alias("errors"))
                    bad = bad.unionByName(against)
                if n["invalid"] + n["conflicts"] + held.conflicts:
                    bad.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{quarantine}/run={run_id}")
                ledger.commit(run_id)
        except Exception as e:
            ledger.abort(run_id, str(e))
            for d in files.names(silver):
                if d.startswith("event_date="):
                    files.delete(f"{silver}/{d}/run={run_id}")
            raise
    finally:
        batch.unpersist()
    stats = Stats(run_id, held.attempt, n["received"], n["valid"], n["invalid"], n["duplicates"] + held.duplicates, n["conflicts"] + held.conflicts, held.n_accepted, held.replayed_run, bronze_path, silver, f"{quarantine}/run={run_id}", f"{root}/manifests/transactions/run={run_id}/attempt={held.attempt:04d}.json")
    files.write(stats.manifest_path, json.dumps(asdict(stats), indent=2, sort_keys=True) + "\n")
    return stats


def committed_silver(spark: SparkSession, root: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Silver events of committed runs; the run is a partition, so others aren't read."""
    path = f"{root}/silver/transactions"
    if not Files(spark).exists(path):
        return spark.createDataFrame([], SILVER)
    runs = Ledger(spark, f"{root}/metadata").runs().filter("status = 'committed'").select(F.col("run_id").alias("run"))
    df = spark.read.schema(T.StructType([*SILVER.fields, T.StructField("run", T.StringType())])).parquet(path).join(runs, "run", "left_semi").select(SILVER.fieldNames())
    return df.filter(F.col("event_date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date"))) if days else df
