"""A session with the settings that the engine's semantics need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Streaming state is kept by this provider.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def build(name: str = "tidemill", **settings: str) -> SparkSession:
    """UTC, adaptive execution and the state store; sizes are left to the cluster's own settings."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.streaming.stateStore.providerClass": STATE_STORE} | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.  A local
    master may do without the setting and gets a temporary one; a cluster may not."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = getattr(sc, "_tidemill_dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemill-shared-")
        sc._tidemill_dir = found
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
