"""Near-duplicate vectors by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard
transform and takes the signed axis nearest to it; a table's bucket is ``k`` such
hashes.  Each vector is also put into the buckets in which one of its hashes is
the second nearest axis instead (multiprobe); a pair is a candidate in a bucket
that is at least one member's own.

Buckets are cut into tiles of about ``TILE`` rows, and each pair of tiles is
a unit of work, so a bucket of any size is spread over tasks.  Cosines are
verified in double precision there.  A pair counts in the first bucket that it
shares, which its codes tell, so links are counted without being emitted: a unit
returns a sum for each row and a spanning forest.  Equal vectors are one row
with a multiplicity from the start.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (n_links 0, component their own id, kept); shorter
vectors count as padded with zeros; rows with a null id are not linked (component
null, kept); an id that is repeated shares the sums of its vectors; an empty table gives
an empty result.  Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components

THRESHOLD = 0.9
TILE = 512
#: Tables for two hashes a bucket, and more for each further one.
TABLES, MORE_TABLES = 8, 8


def plan(rows: int, dim: int) -> tuple[int, int]:
    """Hashes a bucket and tables: buckets stay at a few rows on average."""
    k = 2
    while (2 * dim) ** k < rows / 8:
        k += 1
    return k, TABLES + MORE_TABLES * (k - 2)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform of the rows of x."""
    n, d = x.shape
    for r in range(3):
        signs = 1.0 - 2.0 * (A.mix(np.arange(d, dtype=np.uint64) + np.uint64(1 + 1000003 * (3 * seed + r))) & np.uint64(1)).astype(np.float64)
        x = x * signs
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def codes(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(rows, tables, 1 + k): the own bucket and the probed ones of each table."""
    n, d = x.shape
    out = np.empty((n, tables, 1 + k), np.int64)
    every = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for j in range(k):
            y = rotate(x, t * k + j)
            size = np.abs(y)
            a = size.argmax(1)
            best.append(2 * a + (y[every, a] < 0))
            size[every, a] = -1
            b = size.argmax(1)
            second.append(2 * b + (y[every, b] < 0))
        for v in range(1 + k):
            c = np.zeros(n, np.int64)
            for j in range(k):
                c = c * (2 * d) + (second[j] if v == j + 1 else best[j])
            out[:, t, v] = c
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors, padded with zeros."""
    flat, off = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    n = np.diff(off)
    x = np.zeros((len(column), dim))
    at = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)
    x[at] = flat
    x /= np.abs(x).max(1, keepdims=True)  # squares must neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _entries(reps: DataFrame, dim: int, k: int, tables: int) -> DataFrame:
    """A row for each representative and bucket: place (table and bucket), id, codes."""
    A.ship(reps.sparkSession)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                c = codes(_matrix(b.column(1), dim), k, tables)
                n, width = len(c), tables * (1 + k)
                place = c + (np.arange(tables, dtype=np.int64) << 56)[None, :, None]
                flat = A.binary_rows(c.reshape(-1), np.arange(n + 1) * width)
                # buckets that repeat among a vector's own are one entry
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(place.reshape(-1))), flat], names=["id", "places", "codes"])

    return reps.select("id", "v").mapInArrow(run, "id long, places array<bigint>, codes binary")


def _pairs(group: np.ndarray, chunk: np.ndarray, cross: np.ndarray):
    """Pairs (i, i + k) of one group, k = 1, 2, ...; in units of two tiles only across."""
    n = len(group)
    for k in range(1, n):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            return
        i = i[~cross[i] | (chunk[i] != chunk[i + k])]
        if len(i):
            yield i, i + k


def _work(t: pa.Table, k: int, tables: int, dim: int, threshold: float) -> pa.RecordBatch | None:
    """Sums of links and forests of the complete units of t."""
    place, ti, tj = (t.column(c).to_numpy() for c in ("place", "ti", "tj"))
    ids, times, chunk = (t.column(c).to_numpy() for c in ("id", "times", "chunk"))
    x = _matrix(t.column("v").combine_chunks(), dim)
    code = np.stack([np.frombuffer(b, np.int64) for b in t.column("codes").to_pylist()]).reshape(len(ids), tables, 1 + k)
    new = np.r_[True, (place[1:] != place[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])]
    group = np.cumsum(new)
    table, bucket = (place >> 56).astype(np.int64), place & ((1 << 56) - 1)
    own = code[np.arange(len(ids)), table, 0] == bucket
    links, left, right = np.zeros(len(ids), np.int64), [], []
    for i, j in _pairs(group, chunk, ti != tj):
        some = own[i] | own[j]
        i, j = i[some], j[some]
        close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[close], j[close]
        if not len(i):
            continue
        left.append(i), right.append(j)
        # shared buckets of each table: u's own if v has it, v's own if u has it
        u, v = code[i], code[j]
        a = (u[:, :, :1] == v).any(2)
        b = (v[:, :, :1] == u).any(2)
        shared = a | b
        first = shared.argmax(1)
        here = table[i] == first
        row = np.arange(len(i))
        most = np.int64(2**62)
        least = np.minimum(np.where(a[row, first], u[row, first, 0], most), np.where(b[row, first], v[row, first, 0], most))
        here &= least == bucket[i]
        np.add.at(links, i[here], times[j[here]])
        np.add.at(links, j[here], times[i[here]])
    if not left:
        return None
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            break
    seen = np.unique(np.r_[i, j])
    return pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(links[seen]), pa.array(ids[label[seen]])], names=["id", "links", "root"])


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    with A.Scope() as scope:
        out = scope.keep(A.table(_linked(vectors, key, vector, threshold), "linked"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """id, n_links and component_id of every row."""
    A.ship(vectors.sparkSession)
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"), (F.coalesce(good, F.lit(False)) & F.col(key).isNotNull()).alias("good"))
    # adding zero makes -0.0 and 0.0 one value
    named = rows.filter("good").withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))
    named = named.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})
    reps = A.table(named.groupBy("h", "g").agg(F.min(F.struct("id", "v")).alias("r"), F.count(F.lit(1)).alias("times")).select("h", "g", "r.*", "times"), "vectors")
    facts = reps.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = 1 << max(1, (int(facts[1] or 2) - 1).bit_length())
    k, tables = plan(facts[0], dim)
    entries = A.table(_entries(reps, dim, k, tables), "codes")
    placed = entries.select("id", F.explode(F.array_distinct("places")).alias("place"))
    full = placed.groupBy("place").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").withColumn("chunks", F.ceil(F.col("m") / TILE).cast("int"))
    member = placed.join(full, "place").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    # a tile meets every tile of its bucket, itself included
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    units = member.select("place", "id", "chunk", other).select("place", "id", "chunk", F.least("chunk", "o").alias("ti"), F.greatest("chunk", "o").alias("tj"))
    body = reps.select("id", "times", "v").join(entries.select("id", "codes"), "id")
    units = units.join(body, "id")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    units = units.repartition(parts, "place", "ti", "tj").sortWithinPartitions("place", "ti", "tj", "id").select("place", "ti", "tj", "id", "times", "chunk", "v", "codes")

    def run(batches):
        rest = None
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = pa.Table.from_batches([whole.slice(i, 2048)])
                t = pa.concat_tables([rest, b]).combine_chunks() if rest is not None else b
                last = [t.column(c)[-1].as_py() for c in ("place", "ti", "tj")]
                p, a, z = (t.column(c).to_numpy() for c in ("place", "ti", "tj"))
                open_ = (p == last[0]) & (a == last[1]) & (z == last[2])
                cut = int(open_.argmax())  # the last unit may go on
                rest = t.slice(cut)
                if cut:
                    got = _work(t.slice(0, cut), k, tables, dim, threshold)
                    if got is not None:
                        yield got
        if rest is not None:
            got = _work(rest, k, tables, dim, threshold)
            if got is not None:
                yield got

    found = A.table(units.mapInArrow(run, "id long, links long, root long"), "links")
    label = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = reps.select("id", "h", "g", "times").join(sums, "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    result = result.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = named.select("id", "h", "g").join(result, ["h", "g"]).select("id", "n_links", "component_id")
    return out.union(rows.filter("not good").select("id", F.lit(0).cast("long"), F.col("id")))
