"""Registered queries of the transaction engine, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import contract
from ..functions.money import half_up
from ..operators import features, joins, marts, quality, resolve
from ..sources import transactions
from ..sources.files import Files
from . import ingest, ledger

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The events table as transactions, in SQL.
TX = """tx AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
  'm' || regexp_extract(props, '(\\d+)', 1) AS merchant_id, ts AS event_time, value AS amount, 'TRY' AS currency, event_type AS channel,
  ['TR','DE','NL','GB','US','JP'][1 + CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 6] AS country, CAST(ts AS DATE) AS event_date FROM events)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("$TX", TX)
        return f

    return add


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.from_fixture(spark, sf).withColumn("event_date", F.to_date("event_time"))


def _r(c: str, n: int = 6):
    return half_up(c, n).alias(c)


def _half_up(expression: str, n: int, name: str) -> str:
    return f"floor({expression} * {10**n} + 0.5) / {10**n} AS {name}"


def _micros(c: str):
    return F.unix_micros(c).alias(c)


@query("WITH $TX SELECT event_id, customer_id, epoch_us(event_time) AS event_time, amount, currency, merchant_id, country, channel, CAST(event_date AS VARCHAR) AS event_date, 'r1' AS ingestion_run_id FROM tx")
def stg_transactions(spark, sf):
    fact = marts.fact_transactions(_tx(spark, sf).withColumn("ingestion_run_id", F.lit("r1")))
    return fact.withColumns({"event_time": F.unix_micros("event_time"), "event_date": F.col("event_date").cast("string")})


@query("""WITH $TX SELECT event_id, CAST(event_date AS VARCHAR) AS event_date, CAST(extract(hour FROM event_time) AS INTEGER) AS event_hour,
  CASE WHEN extract(hour FROM event_time) <= 5 THEN 1 ELSE 0 END AS is_night, CASE WHEN country <> 'TR' THEN 1 ELSE 0 END AS is_cross_border, floor(ln(1 + amount) * 1000000 + 0.5) / 1000000 AS log_amount FROM tx""")
def event_features(spark, sf):
    return features.add_event_features(_tx(spark, sf)).select("event_id", F.col("event_date").cast("string").alias("event_date"), "event_hour", "is_night", "is_cross_border", _r("log_amount"))


_VELOCITY = """e AS (SELECT *, CASE WHEN extract(hour FROM event_time) <= 5 THEN 1 ELSE 0 END AS is_night, CASE WHEN country <> 'TR' THEN 1 ELSE 0 END AS is_cross_border, epoch_us(event_time) // 1000000 AS s, CAST(round(amount * 10000) AS BIGINT) AS u FROM tx),
v AS (SELECT *, count(event_id) OVER d AS txn_count_24h, coalesce(CAST(sum(u) OVER d AS DOUBLE) / 10000, 0) AS amount_sum_24h, coalesce(CAST(sum(u) OVER w AS DOUBLE) / (count(amount) OVER w) / 10000, 0) AS amount_avg_7d,
  coalesce(stddev_pop(amount) OVER m, 0) AS amount_std_30d, CAST(coalesce(sum(is_cross_border) OVER w, 0) AS BIGINT) AS cross_border_count_7d, CAST(coalesce(sum(is_night) OVER w, 0) AS BIGINT) AS night_txn_count_7d,
  s - lag(s) OVER (PARTITION BY customer_id ORDER BY event_time, event_id) AS seconds_since_previous_txn
  FROM e WINDOW d AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING),
  w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING),
  m AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING))"""
_VELOCITY_COLUMNS = ", ".join(["txn_count_24h", *[_half_up(c, 4, c) for c in ("amount_sum_24h", "amount_avg_7d", "amount_std_30d")], "cross_border_count_7d, night_txn_count_7d, seconds_since_previous_txn"])


@query(f"WITH $TX, {_VELOCITY} SELECT event_id, {_VELOCITY_COLUMNS} FROM v")
def velocity_features(spark, sf):
    got = features.add_customer_velocity_features(features.add_event_features(_tx(spark, sf)))
    return got.select("event_id", "txn_count_24h", _r("amount_sum_24h", 4), _r("amount_avg_7d", 4), _r("amount_std_30d", 4), "cross_border_count_7d", "night_txn_count_7d", "seconds_since_previous_txn")


_PEER = "CASE WHEN stddev_pop(amount) OVER p > 0 THEN (amount - avg(amount) OVER p) / stddev_pop(amount) OVER p ELSE 0.0 END"


@query(f"WITH $TX SELECT event_id, {_half_up('(avg(amount) OVER p)', 4, 'peer_amount_mean')}, {_half_up('(stddev_pop(amount) OVER p)', 4, 'peer_amount_std')}, {_half_up('(' + _PEER + ')', 4, 'amount_peer_zscore')} FROM tx WINDOW p AS (PARTITION BY event_date, channel)")
def peer_zscore(spark, sf):
    return features.add_peer_features(_tx(spark, sf)).select("event_id", _r("peer_amount_mean", 4), _r("peer_amount_std", 4), _r("amount_peer_zscore", 4))


@query(f"""WITH $TX, {_VELOCITY}, z AS (SELECT *, {_PEER} AS zs FROM v WINDOW p AS (PARTITION BY event_date, channel))
  SELECT event_id, customer_id, epoch_us(event_time) AS event_time, amount, channel, country, {_half_up('ln(1 + amount)', 6, 'log_amount')}, is_night, is_cross_border, {_VELOCITY_COLUMNS}, {_half_up('zs', 4, 'amount_peer_zscore')} FROM z""")
def feature_table(spark, sf):
    four = ("amount_sum_24h", "amount_avg_7d", "amount_std_30d", "amount_peer_zscore")
    got = features.build_feature_table(_tx(spark, sf).filter("amount >= 0"))
    return got.withColumns({"event_time": F.unix_micros("event_time"), "log_amount": _r("log_amount")} | {c: _r(c, 4) for c in four})


@query(f"WITH $TX, z AS (SELECT event_id, {_PEER} AS zs FROM tx WINDOW p AS (PARTITION BY event_date, channel)) SELECT event_id, {_half_up('zs', 4, 'amount_peer_zscore')} FROM z ORDER BY zs DESC, event_id LIMIT 20")
def top_peer_scores(spark, sf):
    return features.top_scores(features.build_feature_table(_tx(spark, sf))).select("event_id", _r("amount_peer_zscore", 4))


_DAILY = """daily AS (SELECT customer_id, CAST(event_date AS VARCHAR) AS event_date, count(*) AS transaction_count, floor(CAST(sum(CAST(round(amount * 10000) AS BIGINT)) AS DOUBLE) / 10000 * 100 + 0.5) / 100 AS gross_amount, floor(CAST(sum(CAST(round(amount * 10000) AS BIGINT)) AS DOUBLE) / count(amount) / 10000 * 100 + 0.5) / 100 AS average_amount,
  count(DISTINCT merchant_id) AS merchant_count, count(DISTINCT country) AS country_count, CAST(count(*) FILTER (WHERE channel = 'purchase') AS BIGINT) AS transfer_count FROM tx GROUP BY 1, 2)"""


def _daily(spark, sf):
    # no event of the fixture is a bank transfer: purchases stand in for them
    return marts.customer_daily_activity(_tx(spark, sf), "purchase").withColumn("event_date", F.col("event_date").cast("string"))


@query(f"WITH $TX, {_DAILY} SELECT * FROM daily")
def customer_daily_activity(spark, sf):
    return _daily(spark, sf)


@query(f"WITH $TX, {_DAILY} SELECT * FROM daily WHERE transaction_count >= 6 OR country_count >= 4 OR gross_amount >= 400")
def high_velocity_customers(spark, sf):
    return marts.high_velocity_customers(_daily(spark, sf), 6, 4, 400)


@query(f"WITH $TX, {_DAILY} SELECT * FROM daily ORDER BY event_date, customer_id")
def export_rows(spark, sf):
    return marts.export_rows(_daily(spark, sf))


@query(f"""WITH $TX, base AS (SELECT customer_id, event_date AS d, count(*) AS transaction_count, sum(CAST(round(amount * 10000) AS BIGINT)) AS u, max(amount) AS max_amount, count(DISTINCT merchant_id) AS unique_merchants,
  CAST(count(*) FILTER (WHERE channel = 'purchase') AS BIGINT) AS atm_transactions FROM tx GROUP BY 1, 2)
  SELECT customer_id, CAST(d AS VARCHAR) AS event_date, transaction_count, {_half_up('(CAST(u AS DOUBLE) / 10000)', 4, 'total_amount')}, {_half_up('(CAST(u AS DOUBLE) / transaction_count / 10000)', 4, 'average_amount')}, max_amount, unique_merchants, atm_transactions,
  {_half_up('(CAST(sum(u) OVER w AS DOUBLE) / (count(u) OVER w) / 10000)', 4, 'rolling_7d_spend')}, {_half_up('(avg(transaction_count) OVER m)', 4, 'rolling_30d_txn_count')} FROM base
  WINDOW w AS (PARTITION BY customer_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), m AS (PARTITION BY customer_id ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def customer_daily_risk(spark, sf):
    got = marts.customer_daily_risk(_tx(spark, sf), "purchase")
    return got.withColumns({"event_date": F.to_date("event_date").cast("string")} | {c: _r(c, 4) for c in ("total_amount", "average_amount", "rolling_7d_spend", "rolling_30d_txn_count")})


def _fact(spark, sf):
    """All orders, and a fact for each supplier, whom no customer row matches."""
    of = lambda table, key, who, amount, mark: spark.read.parquet(f"{sf}/{table}.parquet").select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("event_id"), F.concat(F.lit(mark), F.col(who).cast("string")).alias("customer_id"), F.round(F.col(amount) * 100).cast("int").alias("amount_cents"))
    return of("orders", "o_orderkey", "o_custkey", "o_totalprice", "").unionByName(of("supplier", "s_suppkey", "s_suppkey", "s_acctbal", "s"))


def _dim(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"))


_JOINED = """fact AS (SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(round(o_totalprice * 100) AS INTEGER) AS amount_cents FROM orders
  UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, CAST(round(s_acctbal * 100) AS INTEGER) FROM supplier),
dim AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS segment, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
joined AS (SELECT fact.*, segment, country FROM fact LEFT JOIN dim USING (customer_id))"""


@query(f"WITH {_JOINED} SELECT * FROM joined")
def join_broadcast(spark, sf):
    return joins.broadcast_join(_fact(spark, sf), _dim(spark, sf))


@query(f"WITH {_JOINED} SELECT * FROM joined")
def join_copartitioned(spark, sf):
    return joins.copartitioned_join(_fact(spark, sf), _dim(spark, sf))


@query(f"WITH {_JOINED} SELECT * FROM joined")
def join_salted(spark, sf):
    fact = _fact(spark, sf)
    hot = [r["customer_id"] for r in joins.hot_keys(fact, 5).collect()]  # five rows
    return joins.salted_join(fact, _dim(spark, sf), hot)


@query(f"WITH {_JOINED} SELECT customer_id, count(*) AS \"count\" FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def hot_keys(spark, sf):
    return joins.hot_keys(_fact(spark, sf))


@query(f"""WITH {_JOINED} SELECT segment, country, count(event_id) AS transaction_count, round(sum(amount_cents / 100.0), 2) AS gross_volume, round(avg(amount_cents / 100.0), 2) AS average_ticket,
  quantile_disc(amount_cents / 100.0, 0.95) AS p95_ticket FROM joined GROUP BY 1, 2""")
def segment_stats(spark, sf):
    return joins.segment_stats(joins.broadcast_join(_fact(spark, sf), _dim(spark, sf)), 1_000_000).withColumns({"gross_volume": F.round("gross_volume", 2), "average_ticket": F.round("average_ticket", 2)})


#: A batch of events as JSON lines with faults by event id, and its like in SQL.
def _lines(spark, sf):
    e = _tx(spark, sf).withColumn("id", F.col("event_id").cast("long"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    m = F.col("id") % 20
    amount = F.when(m == 3, "-1.5").when(m == 4, '"12"').otherwise(F.format_string("%.2f", "amount"))
    currency = F.when(m == 5, "try").otherwise("TRY")
    eid = F.when(m == 6, "e1").otherwise(F.concat(F.lit("evt-"), F.lpad("event_id", 8, "0")))
    channel = F.when(m == 7, "cash").otherwise("card")
    time = F.when(m == 8, "2024-01-01").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    more = F.when(m == 9, ',"note":1').otherwise("")
    customer = F.when(m == 10, "").otherwise(F.concat(F.lit('"customer_id":'), quote(F.col("customer_id")), F.lit(",")))
    body = F.concat(F.lit('{"event_id":'), quote(eid), F.lit(","), customer, F.lit('"event_time":'), quote(time), F.lit(',"amount":'), amount, F.lit(',"currency":'), quote(currency), F.lit(',"merchant_id":'), quote(F.col("merchant_id")), F.lit(',"channel":'), quote(channel), more, F.lit("}"))
    raw = F.when(m == 11, "{broken").when(m == 12, "[1]").otherwise(body)
    rows = e.select(F.col("id").alias("line_no"), raw.alias("raw"), F.col("id"))
    # some events come twice: the same, or with another merchant
    copies = rows.withColumn("copy", F.explode(F.when(F.col("id") % 20 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = (F.col("copy") == 1) & (F.col("id") % 40 != 13)
    return copies.select((F.col("line_no") + F.col("copy") * 1_000_000_000).alias("line_no"), F.when(changed, F.replace("raw", F.lit('"merchant_id":"m'), F.lit('"merchant_id":"x'))).otherwise(F.col("raw")).alias("raw"), "id")


_ERRORS = """CASE event_id % 20 WHEN 3 THEN 'minimum:amount' WHEN 4 THEN 'type:amount' WHEN 5 THEN 'pattern:currency' WHEN 6 THEN 'min_length:event_id' WHEN 7 THEN 'enum:channel'
  WHEN 8 THEN 'format:event_time' WHEN 9 THEN 'unexpected:note' WHEN 10 THEN 'missing:customer_id' WHEN 11 THEN 'json:invalid' WHEN 12 THEN 'json:not_an_object' ELSE '' END"""
_BATCH = f"""batch AS (SELECT event_id AS line_no, {_ERRORS} AS errors, CASE WHEN {_ERRORS} <> '' THEN 'invalid' ELSE 'candidate' END AS status FROM events
  UNION ALL SELECT event_id + 1000000000, CASE WHEN event_id % 40 = 13 THEN '' ELSE 'in_batch_event_id_payload_conflict' END, CASE WHEN event_id % 40 = 13 THEN 'duplicate' ELSE 'conflict' END FROM events WHERE event_id % 20 = 13)"""


@query(f"WITH {_BATCH} SELECT line_no, CASE WHEN status IN ('duplicate', 'conflict') THEN '' ELSE errors END AS errors FROM batch")
def contract_errors(spark, sf):
    return contract.checked(_lines(spark, sf)).select("line_no", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {_BATCH} SELECT line_no, errors, status FROM batch")
def in_batch_classify(spark, sf):
    return resolve.classify_batch(_lines(spark, sf)).select("line_no", F.array_join("errors", ",").alias("errors"), "status")


@query(f"""WITH {_BATCH} SELECT count(*) AS received, count(*) FILTER (WHERE status = 'candidate') AS valid, count(*) FILTER (WHERE status = 'invalid') AS invalid,
  count(*) FILTER (WHERE status = 'duplicate') AS duplicates, count(*) FILTER (WHERE status = 'conflict') AS conflicts FROM batch""")
def run_counters(spark, sf):
    return resolve.run_counters(resolve.classify_batch(_lines(spark, sf)))


def _file(spark, lines, path: str) -> str:
    """The lines as one file, in their order."""
    lines.repartition(1).sortWithinPartitions("line_no").select("raw").write.text(path)
    return Files(spark).walk(path, ".txt")[0]


def _stats(spark, **runs):
    fields = ("attempt", "received", "valid", "invalid", "duplicates", "conflicts", "written")
    return spark.createDataFrame([(name, *(getattr(s, f) for f in fields), s.replayed_run) for name, s in runs.items()], "run string, " + ", ".join(f"{f} long" for f in fields) + ", replayed boolean")


_COUNTED = """count(*) AS received, CAST(count(*) FILTER (WHERE status = 'candidate') AS BIGINT) AS valid, CAST(count(*) FILTER (WHERE status = 'invalid') AS BIGINT) AS invalid,
  CAST(count(*) FILTER (WHERE status = 'duplicate') AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE status = 'conflict') AS BIGINT) AS conflicts"""


@query(f"""WITH {_BATCH}, n AS (SELECT {_COUNTED} FROM batch)
  SELECT 'first' AS run, 1 AS attempt, *, valid AS written, false AS replayed FROM n
  UNION ALL SELECT 'replay', 2, received, valid, invalid, duplicates + valid, conflicts, 0, true FROM n""")
def ingest_replay(spark, sf):
    """A batch and the same file again, which writes nothing."""
    root = session.scratch(spark, "ingest")
    path = _file(spark, _lines(spark, sf), f"{root}/in")
    return _stats(spark, first=ingest.ingest(spark, path, root), replay=ingest.ingest(spark, path, root))


@query("""WITH good AS (SELECT event_id FROM events WHERE event_id % 20 NOT BETWEEN 3 AND 12), bad AS (SELECT count(*) AS n FROM events WHERE event_id % 20 BETWEEN 3 AND 12),
  twice AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE event_id % 40 = 13) AS BIGINT) AS same FROM events WHERE event_id % 20 = 13), n AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE event_id % 7 = 0) AS BIGINT) AS changed FROM good)
  SELECT 'second' AS run, 1 AS attempt, (SELECT count(*) FROM events) * 2 + twice.n * 2 AS received, n.n * 2 AS valid, bad.n * 2 AS invalid, twice.same * 2 + n.n - n.changed AS duplicates, (twice.n - twice.same) * 2 + n.changed AS conflicts, n.n AS written, false AS replayed FROM n, bad, twice""")
def ingest_overlap(spark, sf):
    """A batch of events that are known, known with another payload, and new."""
    root = session.scratch(spark, "ingest")
    known = _lines(spark, sf)
    ingest.ingest(spark, _file(spark, known, f"{root}/a"), root)
    changed = F.when(F.col("id") % 7 == 0, F.replace("raw", F.lit('"merchant_id":"'), F.lit('"merchant_id":"other-'))).otherwise(F.col("raw"))
    new = known.select((F.col("line_no") + 4_000_000_000).alias("line_no"), F.replace("raw", F.lit('"event_id":"evt-'), F.lit('"event_id":"new-')).alias("raw"))
    again = known.select("line_no", changed.alias("raw")).unionByName(new)
    return _stats(spark, second=ingest.ingest(spark, _file(spark, again, f"{root}/b"), root))


@query("""SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS event_id, CAST(user_id AS VARCHAR) AS customer_id, round(value, 2) AS amount, 'card' AS channel, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
  FROM events WHERE event_id % 20 NOT BETWEEN 3 AND 12""")
def ingest_retry(spark, sf):
    """Silver after a run that failed before its commit and its retry."""
    root = session.scratch(spark, "ingest")
    path = _file(spark, _lines(spark, sf), f"{root}/in")
    commit, ledger.Ledger.commit = ledger.Ledger.commit, lambda self, run: (_ for _ in ()).throw(OSError("lost"))
    try:
        ingest.ingest(spark, path, root)
    except OSError:
        pass
    finally:
        ledger.Ledger.commit = commit
    if ingest.committed_silver(spark, root).limit(1).count():
        raise AssertionError("an uncommitted run is visible")
    ingest.ingest(spark, path, root)
    return ingest.committed_silver(spark, root).select("event_id", "customer_id", "amount", "channel", F.col("event_date").cast("string").alias("event_date"))


def _ledger(spark, sf):
    """A ledger of as many events, of which some have ids of their own, some another payload or another run."""
    e = _tx(spark, sf).withColumn("id", F.col("event_id").cast("long"))
    digest = F.sha2("event_id", 256)
    candidates = e.select("event_id", digest.alias("payload_sha256"))
    ledger = e.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("old-"), "event_id")).otherwise(F.col("event_id")).alias("event_id"), F.when(F.col("id") % 7 == 0, "other").otherwise(digest).alias("payload_sha256"), F.when(F.col("id") % 5 == 0, "r2").otherwise("r1").alias("run_id"), F.when(F.col("id") % 2 == 0, "reserved").otherwise("committed").alias("state"))
    return candidates, ledger


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'accept' WHEN event_id % 7 = 0 THEN 'conflict' WHEN event_id % 2 = 0 AND event_id % 5 = 0 THEN 'reserved_elsewhere'
  WHEN event_id % 2 = 0 THEN 'accept' ELSE 'duplicate' END AS standing FROM events""")
def ledger_classify(spark, sf):
    return resolve.classify_ledger(*_ledger(spark, sf), "r1").select("event_id", "standing")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l WHERE l.event_id = e.event_id AND l.event_id % 3 <> 0)")
def ledger_unseen(spark, sf):
    return resolve.unseen(*_ledger(spark, sf)).select("event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events e WHERE EXISTS (SELECT 1 FROM events l WHERE l.event_id = e.event_id AND l.event_id % 3 <> 0)")
def ledger_seen(spark, sf):
    return resolve.seen(*_ledger(spark, sf)).select("event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, value AS amount FROM events")
def dedup_events(spark, sf):
    e = _tx(spark, sf)
    later = e.withColumns({"amount": F.col("amount") + 1, "event_time": F.col("event_time") + F.expr("interval 1 hour")})
    return resolve.dedup_events(e.unionByName(later), ["event_time", "amount"]).select("event_id", "amount")


_FAULTS = """x AS (SELECT CASE WHEN event_id % 11 = 1 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN event_id % 11 = 2 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS customer_id, CASE WHEN event_id % 11 = 3 THEN NULL ELSE ts END AS event_time,
  CASE WHEN event_id % 11 = 4 THEN NULL WHEN event_id % 11 = 5 THEN -value - 1 ELSE value END AS amount, CASE WHEN event_id % 11 = 6 THEN NULL ELSE 'TRY' END AS currency, event_id AS id FROM events)"""


@query(f"""WITH {_FAULTS} SELECT id, CASE WHEN event_id IS NULL THEN 'missing_event_id' WHEN customer_id IS NULL THEN 'missing_customer_id' WHEN event_time IS NULL THEN 'missing_event_time' WHEN amount IS NULL THEN 'missing_amount'
  WHEN amount < 0 THEN 'negative_amount' WHEN currency IS NULL THEN 'missing_currency' ELSE 'valid' END AS validation_error FROM x""")
def stream_validation(spark, sf):
    from ..streaming.features import split

    e = _tx(spark, sf).withColumn("id", F.col("event_id").cast("long"))
    m = F.col("id") % 11
    gone = {c: F.when(m != k, F.col(c)) for k, c in ((1, "event_id"), (2, "customer_id"), (3, "event_time"), (6, "currency"))}
    valid, invalid = split(e.withColumns(gone | {"amount": F.when(m == 5, -F.col("amount") - 1).when(m != 4, F.col("amount"))}))
    return valid.select("id", F.lit("valid").alias("validation_error")).unionByName(invalid.select("id", "validation_error"))


_SLIDING = """w AS (SELECT tx.*, CASE WHEN extract(hour FROM event_time) <= 5 THEN 1 ELSE 0 END AS is_night, CASE WHEN country <> 'TR' THEN 1 ELSE 0 END AS is_cross_border, (epoch_us(event_time) // 60000000 - k) * 60000000 AS window_start FROM tx, (SELECT unnest([0, 1, 2, 3, 4]) AS k)),
sliding AS (SELECT customer_id, window_start, window_start + 300000000 AS window_end, count(event_id) AS txn_count_5m, round(sum(amount), 4) AS amount_sum_5m, max(amount) AS amount_max_5m, CAST(sum(is_cross_border) AS BIGINT) AS cross_border_count_5m,
  CAST(sum(is_night) AS BIGINT) AS night_count_5m, count(DISTINCT merchant_id) AS merchant_diversity_5m FROM w GROUP BY 1, 2)"""


def _windows(df):
    return df.withColumns({"amount_sum_5m": F.round("amount_sum_5m", 4), "window_start": F.unix_micros("window_start"), "window_end": F.unix_micros("window_end")})


@query(f"WITH $TX, {_SLIDING} SELECT * FROM sliding")
def sliding_5m(spark, sf):
    return _windows(features.sliding_features(features.add_event_features(_tx(spark, sf))))


def _streamed(spark, sf, plan, name):
    """Runs a stream over the fixture's events to its end and reads what it wrote."""
    root = session.scratch(spark, name)
    transactions.from_fixture(spark, sf).repartition(1).write.parquet(f"{root}/in")
    source = spark.readStream.schema(transactions.from_fixture(spark, sf).schema).parquet(f"{root}/in")
    out = plan(source)
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(f"WITH $TX, {_SLIDING} SELECT * FROM sliding WHERE window_end <= (SELECT max(epoch_us(ts)) - 900000000 FROM events)")
def stream_sliding_5m(spark, sf):
    from ..streaming.features import stream_features

    return _windows(_streamed(spark, sf, lambda s: stream_features(s), "sliding"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events")
def stream_dedup(spark, sf):
    from ..streaming.features import deduplicated

    return _streamed(spark, sf, lambda s: deduplicated(s.unionByName(s), "15 minutes").select("event_id"), "dedup")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'negative_amount' AS validation_error FROM events WHERE event_id % 9 = 0")
def stream_quarantine(spark, sf):
    from ..streaming.features import split

    return _streamed(spark, sf, lambda s: split(s.withColumn("amount", F.when(F.col("event_id").cast("long") % 9 == 0, -F.col("amount") - 1).otherwise(F.col("amount"))))[1].select("event_id", "validation_error"), "invalid")


@query("SELECT count(*) FILTER (WHERE event_id % 10 = 0) AS event_id, 0 AS customer_id, 0 AS event_time, count(*) FILTER (WHERE event_id % 4 = 0) AS amount, 0 AS currency FROM events")
def quality_not_null(spark, sf):
    e = _tx(spark, sf).withColumn("id", F.col("event_id").cast("long"))
    e = e.withColumns({"event_id": F.when(F.col("id") % 10 != 0, F.col("event_id")), "amount": F.when(F.col("id") % 4 != 0, F.col("amount"))})
    return quality.null_counts(e, quality.NOT_NULL["stg_transactions"])


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 1 + event_id % 3 AS \"rows\" FROM events WHERE event_id % 3 > 0")
def quality_unique(spark, sf):
    e = _tx(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("event_id").cast("int") % 3)))
    return quality.repeated_keys(e, quality.UNIQUE["stg_transactions"])


@query(f"WITH {_JOINED} SELECT event_id, customer_id FROM fact WHERE NOT EXISTS (SELECT 1 FROM dim WHERE dim.customer_id = fact.customer_id)")
def quality_orphans(spark, sf):
    return quality.orphans(_fact(spark, sf), _dim(spark, sf), "customer_id").select("event_id", "customer_id")
