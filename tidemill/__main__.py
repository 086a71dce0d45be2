"""python -m tidemill STAGE ...: generate, validate, ingest, marts, features, quality, serve, publish, joins, stream, hourly, daily."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict

from pyspark.sql import functions as F

from . import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    sub = p.add_subparsers(dest="stage", required=True)
    add = lambda name, **args: [(x := sub.add_parser(name)), [x.add_argument(k if k in ("input",) else "--" + k.replace("_", "-"), **v) for k, v in args.items()]]
    add("generate", count={"type": int, "default": 10_000}, seed={"type": int, "default": 42}, output={"default": "data/incoming/transactions"})
    add("validate", input={})
    add("ingest", input={}, data_root={"default": "data"})
    add("marts", data_root={"default": "data"})
    add("features", data_root={"default": "data"}, output={"default": "data/features/transactions"})
    add("quality", data_root={"default": "data"})
    add("serve", data_root={"default": "data"}, dsn={"default": os.environ.get("POSTGRES_DSN", "")}, table={"default": "customer_daily_activity"})
    add("publish", root={"required": True}, bucket={"required": True}, prefix={"default": ""})
    add("joins", transactions={"required": True}, customers={"required": True}, hot={"type": int, "default": 5})
    add("stream", bootstrap_servers={"default": "localhost:9092"}, topic={"default": "transactions"}, source={"default": None}, checkpoint={"default": "data/checkpoints/transactions"}, output={"default": "data/streaming/features"}, quarantine={"default": "data/streaming/invalid"}, watermark={"default": "15 minutes"}, trigger_seconds={"type": int, "default": 30})
    add("hourly", data_root={"default": "data"}, count={"type": int, "default": 10_000}, seed={"type": int, "default": 42}, retries={"type": int, "default": 2}, delay={"type": float, "default": 120})
    add("daily", data_root={"default": "data"}, retries={"type": int, "default": 2}, delay={"type": float, "default": 120})
    a = p.parse_args(argv)
    spark = session.build(f"tidemill-{a.stage}")

    from .operators import features, joins, marts, quality
    from .plans.ingest import committed_silver, ingest
    from .sources import sinks, transactions
    from .sources.files import Files

    if a.stage == "generate":
        sinks.write_jsonl(transactions.generate(spark, a.count, a.seed), a.output)
        print(a.count)
    elif a.stage == "validate":
        from .functions import contract

        bad = contract.checked(transactions.jsonl(spark, a.input)).select("line_no", "errors").filter(F.size("errors") > 0)
        bad.show(20, truncate=False)
        return 2 if bad.limit(1).count() else 0
    elif a.stage == "ingest":
        stats = ingest(spark, a.input, a.data_root)
        print(json.dumps(asdict(stats), indent=2))
        return 2 if stats.invalid or stats.conflicts else 0
    elif a.stage == "marts":
        print(json.dumps(marts.build_marts(committed_silver(spark, a.data_root)), indent=2))
    elif a.stage == "features":
        table = features.build_feature_table(committed_silver(spark, a.data_root).filter("amount >= 0"))
        sinks.write_features(table, a.output)
        features.top_scores(spark.read.parquet(a.output)).show(20, truncate=False)
    elif a.stage == "quality":
        fact = marts.fact_transactions(committed_silver(spark, a.data_root))
        found = [f for n, t in (("stg_transactions", fact), ("customer_daily_activity", marts.customer_daily_activity(fact)), ("customer_daily_risk", marts.customer_daily_risk(fact))) for f in quality.failures(n, t)]
        print(json.dumps(found))
        return 1 if found else 0
    elif a.stage == "serve":
        daily = marts.customer_daily_activity(marts.fact_transactions(committed_silver(spark, a.data_root)))
        print(sinks.write_jdbc(daily, a.dsn, a.table))
    elif a.stage == "publish":
        print(json.dumps(sinks.sync_directory(Files(spark), a.root, a.bucket, a.prefix), indent=2))
    elif a.stage == "joins":
        fact, dim = transactions.minimal(spark, a.transactions), transactions.customers(spark, a.customers)
        hot = [r["customer_id"] for r in joins.hot_keys(fact, a.hot).collect()]  # a.hot rows
        joins.explain(joins.broadcast_join(fact, dim), "Broadcast join")
        salted = joins.salted_join(fact, dim, hot)
        joins.explain(salted, "Salted join")
        joins.segment_stats(salted).show(50, truncate=False)
    elif a.stage in ("hourly", "daily"):
        from .plans import runner, schedules

        stages = schedules.hourly(spark, a.data_root, a.count, a.seed) if a.stage == "hourly" else schedules.daily(spark, a.data_root)
        try:
            done = runner.run_stages(stages, retries=a.retries, delay_s=a.delay, files=Files(spark), lock=f"{a.data_root}/_{a.stage}.lock")
        except schedules.Rejected as e:
            print(e)
            return 2
        print(json.dumps({name: str(result) for name, result in done.items()}, indent=2))
    else:
        from .streaming.features import StreamingConfig, run

        run(spark, StreamingConfig(a.checkpoint, a.output, a.quarantine, a.bootstrap_servers, a.topic, a.source, a.watermark, a.trigger_seconds))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
