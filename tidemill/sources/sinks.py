"""Sinks: JSON lines, partitioned Parquet, object stores, relational tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import Files

#: Files that ``sync_directory`` copies at a time.
COPIES = 16


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_features(df: DataFrame, path: str) -> None:
    """By day, one file a day and task; REBALANCE splits days of very many rows."""
    df.withColumn("event_date", F.to_date("event_time")).hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_sized(df: DataFrame, path: str, partitions: int = 32, by: str = "country") -> None:
    """``partitions`` tasks, partitioned by a column, snappy."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, partitions // 8)))
    df.repartition(partitions, F.col(by), spread).write.mode("overwrite").partitionBy(by).option("compression", "snappy").parquet(path)


def publish(df: DataFrame, root: str, bucket: str, prefix: str = "") -> dict:
    """Copies every Parquet file below root to bucket/prefix (file:// or s3a:// alike)."""
    files = Files(df.sparkSession)
    return sync_directory(files, root, bucket, prefix)


def sync_directory(files: Files, root: str, bucket: str, prefix: str = "") -> dict:
    """Uploads **/*.parquet in order; a summary with at most ten sample keys."""
    base = root.split(":", 1)[-1].rstrip("/")
    paths = files.walk(root, ".parquet")
    keys = ["/".join(x for x in (prefix.strip("/"), path.split(base, 1)[-1].lstrip("/")) if x) for path in paths]
    with ThreadPoolExecutor(COPIES) as pool:
        list(pool.map(lambda one: files.copy(one[0], f"{bucket.rstrip('/')}/{one[1]}"), zip(paths, keys)))
    return {"bucket": bucket, "objects_uploaded": len(keys), "sample_keys": keys[:10]}


def write_jdbc(df: DataFrame, url: str, table: str, key: tuple[str, ...] = ("customer_id", "event_date"), **options: str) -> int:
    """Replaces a relational table's rows; the key must be unique.  Spark's writer truncates
    and inserts in separate transactions, so load a staging table and swap where readers
    mustn't see that."""
    from ..operators.quality import repeated_keys

    if repeated_keys(df, key).limit(1).count():
        raise ValueError(f"{', '.join(key)} isn't unique")
    df.write.jdbc(url, table, mode="overwrite", properties={"truncate": "true", **options})
    return df.count()
