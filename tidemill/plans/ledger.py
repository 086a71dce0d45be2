"""The ingestion ledger: which run owns which event.

A run's events are one Parquet folder, its standing one small JSON file that is
replaced by a rename, so committing a run touches one file however many events it
has.  Events of a staging run are reserved, those of a committed run committed.
One writer at a time holds an exclusively created lock file, for ``lease_s`` seconds at
most: a lock older than that is a crashed writer's and is taken away.

Run standings are read by Spark as one table, and a batch is compared only with the
ledger rows of its own event ids: history is scanned, not shuffled.
"""

from __future__ import annotations

import contextlib
import json
import time
from dataclasses import dataclass
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import CONFLICT, EVENT_LEDGER
from ..operators.resolve import classify_ledger
from ..sources.files import Files


class ConcurrentIngestion(RuntimeError):
    """Another unfinished run has reserved an event."""


class RunIdentityConflict(RuntimeError):
    """A run's id came with different input."""


@dataclass(frozen=True)
class Reservation:
    accepted: DataFrame  # event_id
    conflicting: DataFrame  # event_id
    n_accepted: int
    duplicates: int
    conflicts: int
    replayed_run: bool
    attempt: int


class Ledger:
    def __init__(self, spark: SparkSession, root: str, wait_s: float = 10, lease_s: float = 6 * 3600) -> None:
        self.spark, self.root, self.files, self.wait_s, self.lease_s = spark, str(root).rstrip("/"), Files(spark), wait_s, lease_s

    @contextlib.contextmanager
    def _lock(self):
        path, end, mine = f"{self.root}/_lock", time.time() + self.wait_s, uuid4().hex
        while not self.files.create(path, json.dumps({"owner": mine, "until": time.time() + self.lease_s})):
            self._take_expired(path)
            if time.time() > end:
                raise ConcurrentIngestion(f"{path} is held by another writer")
            time.sleep(0.1)
        try:
            yield
        finally:
            if self._lock_of(path).get("owner") == mine:
                self.files.delete(path)

    def _lock_of(self, path: str) -> dict:
        try:
            return json.loads(self.files.read(path))
        except Exception:  # gone meanwhile, or still being written
            return {}

    def _take_expired(self, path: str) -> None:
        """Moves an expired lock aside; only one writer's rename succeeds."""
        held = self._lock_of(path)
        if held and held["until"] < time.time():
            aside = f"{path}-{held['owner']}"
            with contextlib.suppress(Exception):  # another writer was faster
                self.files.rename(path, aside)
                if self._lock_of(aside).get("owner") != held["owner"]:  # a new lock was moved: put it back
                    self.files.rename(aside, path)

    def _run_path(self, run_id: str) -> str:
        return f"{self.root}/runs/{run_id}.json"

    def run_status(self, run_id: str) -> dict | None:
        path = self._run_path(run_id)
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def _put(self, run: dict) -> None:
        self.files.write(self._run_path(run["run_id"]), json.dumps(run, sort_keys=True))

    def runs(self) -> DataFrame:
        """run_id and status of every run, read by Spark."""
        path = f"{self.root}/runs"
        schema = "run_id string, status string"
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(path) if self.files.exists(path) else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """event_id, payload_sha256, event_date, run_id, state of reserved and committed events."""
        path, runs = f"{self.root}/events", self.runs().filter(F.col("status").isin("staging", "committed"))
        state = F.when(F.col("status") == "staging", "reserved").otherwise("committed").alias("state")
        # folders that begin with _ aren't read: reservations still being written
        held = self.spark.read.schema(EVENT_LEDGER).option("recursiveFileLookup", "true").parquet(path) if self.files.names(path) else self.spark.createDataFrame([], EVENT_LEDGER)
        return held.join(runs, "run_id").select(*EVENT_LEDGER.fieldNames(), state)

    def conflicts(self) -> DataFrame:
        parts = [f"{self.root}/conflicts/{n}" for n in self.files.names(f"{self.root}/conflicts")]
        return self.spark.read.schema(CONFLICT).parquet(*parts) if parts else self.spark.createDataFrame([], CONFLICT)

    def reserve(self, run_id: str, input_sha256: str, received: int, candidates: DataFrame) -> Reservation:
        none = candidates.select("event_id").limit(0)
        with self._lock():
            run = self.run_status(run_id)
            if run and run["input_sha256"] != input_sha256:
                raise RunIdentityConflict(f"run {run_id} has a different input digest")
            attempt = run["attempts"] + 1 if run else 1
            if run and run["status"] == "committed":
                self._put(run | {"attempts": attempt})
                return Reservation(none, none, 0, candidates.count(), 0, True, attempt)
            known = self.events().join(candidates.select("event_id"), "event_id", "left_semi")
            standing = classify_ledger(candidates, known, run_id).persist()
            try:
                taken = standing.filter("standing = 'reserved_elsewhere'").select("event_id", "owner").first()
                if taken:
                    raise ConcurrentIngestion(f"event {taken['event_id']} is reserved by run {taken['owner']}")
                n = standing.groupBy("standing").count()
                n = {r["standing"]: r["count"] for r in n.collect()}  # at most four rows
                # written beside and renamed: the run's own reservations are being read
                place = f"{self.root}/events/run={run_id}"
                standing.filter("standing = 'accept'").select("event_id", "payload_sha256", "event_date", F.lit(run_id).alias("run_id")).write.mode("overwrite").parquet(f"{self.root}/events/_{run_id}")
                standing.filter("standing = 'conflict'").select("event_id", "existing_sha256", F.col("payload_sha256").alias("incoming_sha256"), F.lit(run_id).alias("incoming_run_id")).write.mode("overwrite").parquet(f"{self.root}/conflicts/run={run_id}-{attempt}")
                self.files.delete(place)
                self.files.rename(f"{self.root}/events/_{run_id}", place)
            finally:
                standing.unpersist()
            now = datetime.now(UTC).isoformat()
            self._put({"run_id": run_id, "input_sha256": input_sha256, "status": "staging", "received": received, "accepted": n.get("accept", 0), "duplicates": n.get("duplicate", 0), "conflicts": n.get("conflict", 0), "started_at": (run or {}).get("started_at", now), "committed_at": None, "failure_reason": None, "attempts": attempt})
        accepted = self.spark.read.schema(EVENT_LEDGER).parquet(place).select("event_id")
        conflicting = self.spark.read.schema(CONFLICT).parquet(f"{self.root}/conflicts/run={run_id}-{attempt}").select("event_id")
        return Reservation(accepted, conflicting, n.get("accept", 0), n.get("duplicate", 0), n.get("conflict", 0), False, attempt)

    def commit(self, run_id: str) -> None:
        with self._lock():
            run = self.run_status(run_id)
            if not run or run["status"] != "staging":
                raise RuntimeError(f"run {run_id} is not staging")
            self._put(run | {"status": "committed", "committed_at": datetime.now(UTC).isoformat()})

    def abort(self, run_id: str, reason: str) -> None:
        with self._lock():
            run = self.run_status(run_id)
            if run and run["status"] == "staging":
                self._put(run | {"status": "failed", "failure_reason": reason[:1000]})
                self.files.delete(f"{self.root}/events/run={run_id}")
