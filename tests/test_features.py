"""Window edges, join equality and streaming behaviour."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemill.functions.schema import FEATURE_COLUMNS, TRANSACTION
from tidemill.operators import features, joins
from tidemill.streaming import features as streaming

START = datetime(2026, 1, 1, 12, tzinfo=UTC)


def rows(spark, *items):
    return spark.createDataFrame([(f"evt-{i:08d}", c, "m1", START + timedelta(seconds=s), float(a), "TRY", "card", country) for i, (c, s, a, country) in enumerate(items)], TRANSACTION)


def test_windows_exclude_the_event_and_its_second(spark):
    got = features.build_feature_table(rows(spark, ("c1", 0, 10, "TR"), ("c1", 86_400, 25, "DE"), ("c1", 86_400.5, 5, None), ("c1", 172_801, 1, "TR"))).orderBy("event_time").collect()
    assert tuple(got[0].asDict()) == FEATURE_COLUMNS
    assert [r["txn_count_24h"] for r in got] == [0, 1, 1, 0]  # exactly a day ago counts, a second more doesn't
    assert [r["amount_sum_24h"] for r in got] == [0.0, 10.0, 10.0, 0.0]
    assert [r["is_cross_border"] for r in got] == [0, 1, 0, 0]
    assert [r["seconds_since_previous_txn"] for r in got] == [None, 86_400, 0, 86_401]
    assert got[1]["amount_std_30d"] == 0.0


def test_peer_scores_of_one_row_or_no_variance(spark):
    got = features.add_peer_features(features.add_event_features(rows(spark, ("a", 0, 5, "TR"), ("b", 1, 5, "TR"), ("c", 90_000, 7, "TR"))))
    assert {r["amount_peer_zscore"] for r in got.collect()} == {0.0}


def test_joins_agree_on_a_hot_key(spark):
    fact = spark.range(3000).select(F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("customer_id"), F.col("id").cast("int").alias("amount_cents"))
    dim = spark.createDataFrame([("hot", "A", "TR"), ("3", "B", "DE")], "customer_id string, segment string, country string")
    plain = fact.join(dim, "customer_id", "left")
    for got in (joins.broadcast_join(fact, dim), joins.broadcast_join(fact, dim, limit=1), joins.copartitioned_join(fact, dim, partitions=8), joins.salted_join(fact, dim, ["hot"]), joins.salted_join(fact, dim, [])):
        got = got.select(plain.columns)
        assert got.exceptAll(plain).count() == 0 == plain.exceptAll(got).count()
    plan = joins.copartitioned_join(fact, dim)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_stream_validation(spark):
    got = streaming.split(rows(spark, ("c", 0, 10, "TR"), ("c", 1, -1, "TR"), ("c", 2, float("nan"), "TR")))
    assert [r["event_id"] for r in got[0].collect()] == ["evt-00000000"]
    assert sorted(r["validation_error"] for r in got[1].collect()) == ["missing_amount", "negative_amount"]


def test_stream_from_files_with_restart_and_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *events):
        body = "\n".join('{"event_id":"%s","customer_id":"c","event_time":"2026-01-01T%s:00Z","amount":1.0,"currency":"TRY","merchant_id":"m","country":"DE","channel":"card"}' % e if isinstance(e, tuple) else e for e in events)
        (folder / name).write_text(body + "\n")

    config = streaming.StreamingConfig(str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "bad"), input_path=str(folder), available_now=True)
    put("1.json", ("e1", "12:00"), ("e1", "12:00"), "{broken")
    streaming.run(spark, config)
    for i, e in enumerate([("e2", "13:00"), ("e3", "13:01"), ("late", "12:02"), ("e4", "14:00"), ("e5", "14:30")]):
        put(f"{i + 2}.json", e)
        streaming.run(spark, config)  # each run goes on from the checkpoint
    got = {(r["window_start"].strftime("%H:%M"), r["txn_count_5m"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("12:00", 1) in got and ("11:56", 1) in got  # the repeated event counts once
    assert all(n == 1 for w, n in got if w < "12:05")  # the late event is dropped
    assert spark.read.parquet(str(tmp_path / "bad")).select("json_payload", "validation_error").collect() == [("{broken", "missing_event_id")]


def test_merchants_of_a_window_are_counted_exactly(spark, tmp_path):
    """A sketch counted these some too many or too few."""
    events = spark.range(400).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("c").alias("customer_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("m"), F.col("id"))).alias("merchant_id"),
        F.lit(START).alias("event_time"), F.lit(1.0).alias("amount"), F.lit("TRY").alias("currency"), F.lit("card").alias("channel"), F.lit("TR").alias("country"),
    )
    later = events.limit(1).withColumns({"event_id": F.lit("later"), "event_time": F.lit(START + timedelta(hours=1))})
    assert [r["merchant_diversity_5m"] for r in features.sliding_features(features.add_event_features(events)).collect()] == [300] * 5
    events.union(later).write.parquet(str(tmp_path / "in"))
    out = streaming.stream_features(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [r["merchant_diversity_5m"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [300] * 5
