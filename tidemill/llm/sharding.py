"""Sharding by Karmarkar-Karp differencing: tight byte balance for indivisible groups.

Rows with equal texts are one group and stay together.  A partial partition is
one number of bytes for each shard; a single group is (size, 0, ..., 0).
Differencing takes the two partial partitions with the largest spread and adds
them in opposite orders, largest to smallest, until one is left.

Blocks of ``BLOCK`` partial partitions are differenced each in a task of its own
into one; their results are the partial partitions of the next level, until one
block holds them all, so no task or driver gathers the groups.  A row's shard
follows from its group's slot at each level.

Law: ``bytes`` (sizes near equal).  A group larger than a shard's share makes
its shard that much larger: groups are indivisible.

Defined results: size is the text's UTF-8 bytes plus 16, a null text has none
and is grouped with the empty text; repeated rows (even of one doc_id) each get
a slot; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A

BLOCK = 4096
#: Rows that one task numbers, about.
SLOT_ROWS = 1 << 17


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of partial partitions, (m, k) sizes: the final k sizes, and
    for each part and slot the final slot it went to."""
    m, k = parts.shape
    sums = [p for p in parts]
    heap = [(int(p.min() - p.max()), i) for i, p in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        total = sums[a][down] + sums[b][up]
        joined.append((a, down, b, up))
        sums[a] = sums[b] = None
        sums.append(total)
        heapq.heappush(heap, (int(total.min() - total.max()), len(sums) - 1))
    place: list = [None] * len(sums)
    place[-1] = np.arange(k)
    for j in range(len(joined) - 1, -1, -1):
        a, down, b, up = joined[j]
        mine, place[m + j] = place[m + j], None
        for part, order in ((a, down), (b, up)):
            to = np.empty(k, np.int64)
            to[order] = mine
            place[part] = to
    return sums[-1], np.stack(place[:m])


def _level(units: DataFrame, shards: int, blocks: int) -> DataFrame:
    """units: block, unit, sizes (array<bigint>) -> block, unit, place (array<int>), and
    for each block one row of unit null with its final sizes."""

    def run(key, t):
        t = t.combine_chunks().sort_by("unit")
        sizes = t.column("sizes").combine_chunks()
        parts = np.zeros((t.num_rows, shards), np.int64)
        flat, off = sizes.flatten().to_numpy(), sizes.offsets.to_numpy() - sizes.offsets.to_numpy()[0]
        n = np.diff(off)
        parts[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat
        total, place = difference(parts)
        lists = pa.array([*place.astype(np.int32).tolist(), None], pa.list_(pa.int32()))
        sums = pa.array([*[None] * len(place), total.tolist()], pa.list_(pa.int64()))
        return pa.table({"block": pa.array([key[0].as_py()] * (len(place) + 1), pa.int64()), "unit": pa.array([*t.column("unit").to_pylist(), None], pa.int64()), "place": lists, "sums": sums})

    # blocks are few rows and much work: a stated number of partitions isn't merged by its bytes
    spark = units.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return units.repartition(min(blocks, most), "block").groupBy("block").applyInArrow(run, "block long, unit long, place array<int>, sums array<bigint>")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard and slot of every row."""
    with A.Scope() as scope:
        placed = scope.keep(A.table(_placed(docs, shards, key, text), "placed"))
    return _slots(placed).withColumnsRenamed({"key": key, "crc": "text_crc32"})


def _placed(docs: DataFrame, shards: int, key: str, text: str) -> DataFrame:
    """key, size, crc and shard of every row."""
    A.ship(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # two chained 64-bit hashes name a text
    rows = A.table(docs.select(F.col(key).alias("key"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("g")), "rows")
    groups = A.table(rows.groupBy("h", "g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    n = groups.count()
    # groups of like size meet in a block only by chance: blocks are by hash
    blocks = max(1, -(-n // BLOCK))
    block_of = lambda b, c: F.pmod(F.col(c), F.lit(b)).cast("long")
    # a group's number within its block is its place in the block's order of hashes
    numbered = A.table(groups.withColumn("block", block_of(blocks, "h")).withColumn("unit", F.row_number().over(Window.partitionBy("block").orderBy("h", "g")).cast("long")), "units")
    got = A.table(_level(numbered.select("block", "unit", F.array("bytes").alias("sizes")), shards, blocks), "level")
    # slot 0 of a single group is the only one that holds bytes
    found = numbered.join(got.filter("unit is not null").select("block", "unit", F.col("place")[0].alias("slot")), ["block", "unit"]).select("h", "g", "block", "slot")
    while blocks > 1:
        upper = max(1, -(-blocks // BLOCK))
        units = got.filter("unit is null").select(F.pmod(F.xxhash64("block"), F.lit(upper)).alias("block"), F.col("block").alias("unit"), F.col("sums").alias("sizes"))
        got = A.table(_level(units, shards, upper), "level")
        step = got.filter("unit is not null").select(F.col("unit").alias("block"), F.col("block").alias("upper"), "place")
        found = found.join(step, "block").select("h", "g", F.col("upper").alias("block"), F.element_at("place", F.col("slot") + 1).alias("slot"))
        blocks = upper
    return rows.join(found.select("h", "g", F.col("slot").alias("shard")), ["h", "g"]).select("key", "size", "crc", "shard")


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless slots in each shard: counts of small buckets first, then numbers within them."""
    buckets = max(1, -(-placed.count() // SLOT_ROWS)) * 4
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("key", "crc"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "crc", "size")) - 1
    return placed.withColumn("own", own).join(before, ["shard", "bucket"]).select("key", "size", "crc", "shard", (F.col("base") + F.col("own")).cast("long").alias("slot"))
