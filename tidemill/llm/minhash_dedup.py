"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of a text's shingles is evaluated once and gives two signature
values, the least and the greatest, so ``HASHES`` permutations make ``2 *
HASHES`` unbiased values of lower variance than as many independent minima.
Bands of ``ROWS`` values bucket the texts.

Texts with equal shingle sets are one representative from the start.  Within a
bucket links are sought in two steps, so that no bucket's pairs are emitted:

1. every member is compared with the bucket's most central one (whose buckets hold
   most others; ties: smallest key);
2. after the components of the links found so far, members of one bucket in
   *different* components are compared, tile by tile, if the sizes of their sets
   and their one-bit sketches leave the threshold possible; a pair is taken in the
   first bucket that it shares, and only pairs that link are emitted.

All links are confirmed on full shingle sets.  The second step skips pairs that links
found before connect; it finds them on the low 32 bits of the shingles, and if a full
set then denies one of them, it is repeated on full sets, so no link goes by a
denied one.  Two texts of similarity s share no band with probability
``(1 - s**ROWS)**(2 * HASHES / ROWS)``: 8e-6 at 0.85, 3.6e-4 at 0.8.  A pair at the
threshold is lost by its sketches with a smaller probability than that (the exact
binomial tail, ``sketch_limit``).

Defined results: a text without words (null, empty, white space) has the empty
set, links with nothing and is kept; a text of fewer words than a shingle has
its whole sequence as its one shingle; component and kept follow the smallest
key; rows with a null key are not linked (component null, kept); rows repeated
with one key share their result.  An empty table gives an empty result.  Other
columns aren't read by ``link`` and are passed through by ``dedup``.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import components

HASHES, ROWS = 50, 5
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Rows of a bucket in one tile, and texts that one task compares with a hub.
TILE, HUB_ROWS = 1024, 4096
#: Bits of a shingle in a brief set.
BRIEF_BITS = 32
#: Above this many rows of ids the join with the texts isn't a broadcast.
BROADCAST_ROWS = 2_000_000
_MULTIPLY = A.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingles(block: A.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their bounds."""
    words = A.words_of(block)
    h = A.SpanHash(block.data, A.BYTE_KEYS_LOWER)(words.starts, words.ends)
    counts = words.counts
    first, owner = A.windows(counts, words.bounds, width)
    keys = h[first] if len(first) else h[:0]
    for k in range(1, width):
        keys = A.pair(keys, h[first + k])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            seq = h[words.bounds[t] : words.bounds[t + 1]]
            x = seq[:1]
            for k in range(1, len(seq)):
                x = A.pair(x, seq[k : k + 1])
            extra[i] = A.mix(x ^ np.uint64(len(seq)))[0]
        keys, owner = np.r_[keys, extra], np.r_[owner, short]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        fresh = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
        keys, owner = keys[fresh], owner[fresh]
    return keys, np.searchsorted(owner, np.arange(len(block) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts with shingles, 2 * HASHES): least and greatest under each permutation."""
    full = np.flatnonzero(np.diff(bounds))
    at = bounds[:-1][full]
    out = np.empty((len(full), 2 * HASHES), np.uint64)
    for i in range(HASHES if len(full) else 0):
        v = keys * _MULTIPLY[i]
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 2 * i] = np.minimum.reduceat(v, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(v, at)
    return out


def _sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n, f and g (two hashes of the whole set), bits (128 of the sketch), bands."""

    def start():
        def work(column):
            n, f, g, low, high, bands, full = [], [], [], [], [], [], []
            for block in A.text_blocks(column):
                keys, bounds = shingles(block, width)
                size = np.diff(bounds)
                n.append(size)
                sums = [np.zeros(len(block), np.uint64) for _ in range(2)]
                sig = signatures(keys, bounds)
                some = size > 0
                if some.any():
                    sums[0][some] = np.add.reduceat(A.mix(keys), bounds[:-1][some])
                    sums[1][some] = np.add.reduceat(A.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][some])
                f.append(sums[0]), g.append(sums[1])
                bits = (A.mix(sig) >> np.uint64(7)) & np.uint64(1)
                half = [np.zeros(len(block), np.uint64) for _ in range(2)]
                for i in range(2 * HASHES):
                    half[i // 64][some] |= bits[:, i] << np.uint64(i % 64)
                low.append(half[0]), high.append(half[1])
                band = sig.reshape(len(sig), 2 * HASHES // ROWS, ROWS)
                b = A.mix(np.arange(2 * HASHES // ROWS, dtype=np.uint64))[None, :] * np.ones((len(sig), 1), np.uint64)
                for r in range(ROWS):
                    b = A.pair(b, band[:, :, r])
                bands.append(b.ravel()), full.append(some)
            ends = np.r_[0, np.cumsum(np.concatenate(full) * (2 * HASHES // ROWS))]
            return [pa.array(np.concatenate(n).astype(np.int64)), *(A.long_array(np.concatenate(x)) for x in (f, g, low, high)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), A.long_array(np.concatenate(bands)))]

        return work

    return A.append_columns(docs, text, [key], [("n", "bigint"), ("f", "bigint"), ("g", "bigint"), ("low", "bigint"), ("high", "bigint"), ("bands", "array<bigint>")], start)


def _with_sets(docs: DataFrame, more: DataFrame, key: str, text: str, width: int, brief: bool) -> DataFrame:
    """The rows of ``more`` (k and others, a row for each k) with the sorted shingle
    hashes of their texts in ``set``; ``brief``: their low ``BRIEF_BITS`` bits.  The side without
    texts is broadcast if it has at most ``BROADCAST_ROWS`` rows; else it is a plain join."""
    small = more.count() <= BROADCAST_ROWS
    bits = BRIEF_BITS
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).join(F.broadcast(more) if small else more, "k")

    def start():
        def work(column):
            parts = []
            for block in A.text_blocks(column):
                keys, bounds = shingles(block, width)
                if brief:
                    owner = np.repeat(np.arange(len(block), dtype=np.uint64), np.diff(bounds))
                    keys = np.sort((owner << np.uint64(32)) | (keys & np.uint64((1 << bits) - 1))).astype(np.uint32)
                parts.append(A.binary_rows(keys, bounds))
            return [pa.concat_arrays(parts)]

        return work

    return A.append_columns(named, "t", more.columns, [("set", "binary")], start)


@cache
def sketch_limit(numerator: int, denominator: int) -> int:
    """Bits in which the sketches of texts at the threshold or above may differ: the least
    number beyond which the binomial tail is smaller than the bands' own loss."""
    s, n = numerator / denominator, 2 * HASHES
    p, loss = (1 - s) / 2, (1 - s**ROWS) ** (n // ROWS)
    tail = [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    return next(k for k in range(n + 1) if sum(tail[k + 1 :]) <= loss)


def _unit(t: pa.Table, numerator: int, denominator: int, limit: int, kind=np.uint32) -> list[tuple[int, int]]:
    """Links of one bucket (or of two of its tiles) between different components,
    found by sketches and sets; pairs that those found connect are skipped."""
    k, c, n, low, high, chunk = (t.column(x).to_numpy() for x in ("k", "c", "n", "low", "high", "chunk"))
    if (c == c[0]).all():
        return []
    band, cross = t.column("band")[0].as_py(), t.column("ti")[0].as_py() != t.column("tj")[0].as_py()
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(k), -1)
    left, right, far = [], [], []
    for i in range(len(k) - 1):
        d = np.bitwise_count(low[i] ^ low[i + 1 :]) + np.bitwise_count(high[i] ^ high[i + 1 :])
        m = n[i + 1 :]
        ok = (d <= limit) & (c[i] != c[i + 1 :]) & (denominator * np.minimum(n[i], m) >= numerator * np.maximum(n[i], m))
        if cross:
            ok &= chunk[i] != chunk[i + 1 :]
        j = np.flatnonzero(ok)
        if len(j):
            same = bands[i] == bands[i + 1 + j]
            j = j[bands[i][same.argmax(1)] == band]  # the first bucket that both are in
            left.append(np.full(len(j), i)), right.append(i + 1 + j), far.append(d[j])
    if not left:
        return []
    i, j, d = (np.concatenate(x) for x in (left, right, far))
    brief, parent, found = t.column("brief"), {}, []
    sets: dict[int, np.ndarray] = {}

    def of(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = np.frombuffer(brief[x].as_py(), kind)
        return sets[x]

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    for x, y in zip(i[np.argsort(d, kind="stable")].tolist(), j[np.argsort(d, kind="stable")].tolist()):
        p, q = root(int(c[x])), root(int(c[y]))
        if p == q:
            continue
        u, v = of(x), of(y)
        s = np.sort(np.concatenate((u, v)))
        both = int((s[1:] == s[:-1]).sum())
        if denominator * both >= numerator * (len(u) + len(v) - both):
            parent[p] = q
            found.append((int(k[x]), int(k[y])))
    return found


def _mixed_links(members: DataFrame, sizes: DataFrame, numerator: int, denominator: int, kind=np.uint32) -> DataFrame:
    """(a, b): links between members of one bucket in different components.  Buckets
    are cut into tiles of about TILE rows; each pair of tiles is a unit of work."""
    A.ship(members.sparkSession)
    sizes = A.table(sizes.select("band", F.ceil(F.col("m") / TILE).cast("int").alias("chunks")), "sizes")
    rows = members.join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"ti": F.least("chunk", "o"), "tj": F.greatest("chunk", "o")})
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.select("band", "ti", "tj", "k", "c", "n", "low", "high", "bands", "brief", "chunk").repartition(parts, "band", "ti", "tj").sortWithinPartitions("band", "ti", "tj", "k")

    limit = sketch_limit(numerator, denominator)

    def run(batches):
        rest = None
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = pa.Table.from_batches([whole.slice(s, 1024)])
                t = pa.concat_tables([rest, b]).combine_chunks() if rest is not None else b
                key = [t.column(x).to_numpy() for x in ("band", "ti", "tj")]
                new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key])) + 1
                ends = new.tolist()
                found = [p for f, e in zip([0, *ends], ends) for p in _unit(t.slice(f, e - f), numerator, denominator, limit, kind)]
                rest = t.slice(ends[-1] if ends else 0)  # the last unit may go on
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        if rest is not None and (found := _unit(rest, numerator, denominator, limit, kind)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (hub, k) whose full sets reach the threshold.

    Each text's set goes once to every hub that it is compared with, where the hub's
    own set comes first.  Hubs of more than ``HUB_ROWS`` texts are cut into chunks, each
    with a copy of the hub's set."""
    A.ship(pairs.sparkSession)
    chunks = A.table(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("chunks")), "hubs")
    own = chunks.select("hub", F.col("hub").alias("k"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("place"))
    others = pairs.join(chunks, "hub").select("hub", "k", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("place"))
    meets = A.table(own.unionByName(others).groupBy("k").agg(F.collect_list(F.struct("hub", "chunk", "place")).alias("meets")), "meets")
    sets = _with_sets(docs, meets, key, text, width, False).select("k", "set", F.explode("meets").alias("m")).select("m.*", "k", "set")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sets = sets.repartition(parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", "place", "k")

    def run(batches):
        here, u = None, None
        for b in batches:
            found = []
            for hub, chunk, place, k, raw in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                v = np.frombuffer(raw.as_buffer(), np.uint64)
                if place == 0:
                    here, u = (hub, chunk), v
                elif here == (hub, chunk):
                    s = np.sort(np.concatenate((u, v)))
                    both = int((s[1:] == s[:-1]).sum())
                    if denominator * both >= numerator * (len(u) + len(v) - both):
                        found.append((hub, k))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return sets.select("hub", "chunk", "place", "k", "set").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """key, n_shingles, component_id and kept of every row; similarity at least
    numerator/denominator links.  The key is a whole number."""
    with A.Scope() as scope:
        out = scope.keep(A.table(_linked(docs, key, text, width, numerator, denominator), "linked"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, key: str, text: str, width: int, numerator: int, denominator: int) -> DataFrame:
    """k, n and component_id of every row."""
    rows = A.table(_sketches(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), "k", "t", width), "sketches")
    alone = (F.col("n") == 0) | F.col("k").isNull()
    # equal sets: one representative, counted before the shuffle
    reps = A.table(rows.filter(~alone).groupBy("f", "g").agg(F.min(F.struct("k", "n", "low", "high", "bands")).alias("r")).select("f", "g", "r.*"), "reps")
    slim = reps.select("k", "n", "low", "high")
    member = reps.select("k", F.explode("bands").alias("band"))
    many = member.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = A.table(member.join(many, "band"), "members")
    # the text that shares most with others is the likeliest centre of its copies
    central = member.join(member.groupBy("k").agg(F.sum("m").alias("share")), "k")
    hub = central.groupBy("band").agg(F.max(F.struct("share", (-F.col("k")).alias("less"))).alias("r")).select("band", (-F.col("r.less")).alias("hub"))
    member = A.table(member.join(hub, "band").select("k", "band", "hub"), "members")
    facts = lambda c, x: slim.select(F.col("k").alias(c), *[F.col(n).alias(n + x) for n in ("n", "low", "high")])
    star = member.filter("k <> hub").select("hub", "k").distinct().join(facts("hub", "a"), "hub").join(facts("k", "b"), "k")
    star = A.table(star.filter(_near("na", "lowa", "higha", "nb", "lowb", "highb", numerator, denominator)).select("hub", "k"), "star")
    links = A.table(_confirm(star, docs, key, text, width, numerator, denominator), "confirmed")
    label = components(links)
    # what a bucket still holds in different components
    seen = member.join(label.withColumnRenamed("node", "k"), "k", "left").select("band", "k", F.coalesce("component", "k").alias("c"))
    mixed = seen.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("band")
    side = A.table(seen.join(mixed, "band", "left_semi").groupBy("k", "c").agg(F.collect_list("band").alias("in")).join(reps.select("k", "n", "low", "high", "bands"), "k"), "mixed")
    sizes = side.select(F.explode("in").alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("m"))

    def rest_of(brief: bool) -> DataFrame:
        rows = _with_sets(docs, side, key, text, width, brief).withColumnRenamed("set", "brief").withColumn("band", F.explode("in")).drop("in")
        return A.table(_mixed_links(rows, sizes, numerator, denominator, np.uint32 if brief else np.uint64).select(F.col("a").alias("hub"), F.col("b").alias("k")).distinct(), "rest")

    rest = rest_of(True)
    more = A.table(_confirm(rest, docs, key, text, width, numerator, denominator), "confirmed")
    if more.count() < rest.count():  # a denied pair may have stood for others: once more on full sets
        more = A.table(_confirm(rest_of(False), docs, key, text, width, numerator, denominator), "confirmed")
    label = components(links.union(more))
    of_set = reps.join(label.withColumnRenamed("node", "k"), "k", "left").select("f", "g", F.coalesce("component", "k").alias("component_id"))
    placed = rows.filter(~alone).select("k", "n", "f", "g").join(of_set, ["f", "g"]).select("k", "n", "component_id")
    return placed.union(rows.filter(alone).select("k", "n", F.col("k").alias("component_id")))


def _near(na, la, ha, nb, lb, hb, numerator, denominator):
    """The set sizes and sketches of two texts leave the threshold possible."""
    sizes = denominator * F.least(na, nb) >= numerator * F.greatest(na, nb)
    return sizes & (F.bit_count(F.col(la).bitwiseXOR(F.col(lb))) + F.bit_count(F.col(ha).bitwiseXOR(F.col(hb))) <= sketch_limit(numerator, denominator))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: one document of each group of near duplicates."""
    gone = link(docs, key, text, **options).filter(~F.col("kept")).select(F.col(key)).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)
