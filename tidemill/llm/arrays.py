"""Arrow columns as flat numpy arrays: blocks of whole texts, words, lines and hashes.

Everything here works on the UTF-8 bytes of many texts at once.  A block holds
whole texts and about ``limit`` bytes, so a worker's memory follows the block
(or the longest single text), never the partition.
"""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ..session import scratch

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
#: `[^\x20\x09-\x0D]+` is a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes alike.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- session

#: Rows and bytes of one Arrow batch: a worker's memory follows these, not Spark's default of 10,000 rows of any size.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def ship(spark) -> None:
    """Makes this package importable in Python workers that don't share the driver's path,
    and keeps Arrow batches small."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_tidemill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "tidemill")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root))
    sc.addPyFile(path)
    sc._tidemill_shipped = True


#: Seconds between the driver's collections.
COLLECT_S = 2.0
_collected = [0.0]


def collect_garbage(spark) -> None:
    """The driver collects its garbage, unless it did so just before."""
    if time.monotonic() - _collected[0] > COLLECT_S:
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()


def table(df, name: str, by: str | None = None):
    """Writes df as Parquet in the shared folder, in a folder for each value of ``by``, and
    reads it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # the shuffles that made it are garbage now: Spark removes their files when the driver collects it
    collect_garbage(spark)
    got = spark.read.schema(df.schema).parquet(path)
    got._tidemill_path = path
    if _scopes:
        _scopes[-1].tables.append(got)
    return got


def drop(*tables) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._tidemill_path)


def _delete(spark, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """Deletes at its end the tables written within, but for those that it was told to keep."""

    def __init__(self) -> None:
        self.tables, self.kept = [], []

    def keep(self, *tables):
        self.kept += tables
        return tables[0]

    def __enter__(self) -> Scope:
        _scopes.append(self)
        return self

    def __exit__(self, *error) -> None:
        _scopes.remove(self)
        paths = {t._tidemill_path for t in self.kept}
        drop(*(t for t in self.tables if t._tidemill_path not in paths))
        if _scopes:
            _scopes[-1].tables += self.kept


_scopes: list[Scope] = []


_heavy: dict[str, object] = {}


def only(name: str, make):
    """A large object of a Python worker (a model, a vocabulary), made once; a worker
    that goes on to another operator drops the one before."""
    if name not in _heavy:
        _heavy.clear()
        _heavy[name] = make()
    return _heavy[name]


def taken(shared):
    """A broadcast's value, which the worker then doesn't hold any longer."""
    value = shared.value
    if hasattr(shared, "_value"):
        del shared._value
    return value


#: Rows and bytes of one piece of a table that workers look up: a worker's and the driver's memory follow these, not the table.
PIECE_ROWS, PIECE_BYTES = 2_000_000, 16 << 20
#: More pieces than this are dealt by a shuffle, else each task would write a file for each.
PIECES_BY_TASK = 32


class Pieces:
    """A table of distinct 64-bit keys and values as broadcasts of sorted arrays, each of a range of
    keys.  A table of one piece stays in the worker, with the others of its ``owner``; of several,
    the worker loads one after another."""

    def __init__(self, owner: str, shared: list[tuple]) -> None:
        self.owner, self.shared, self.name = owner, shared, uuid.uuid4().hex

    @classmethod
    def of(cls, owner: str, df, bits: int = 64, key: str = "key", values: tuple[str, ...] = ("v",), spent=None) -> Pieces:
        """All rows of df, whose keys have ``bits`` bits, in ranges of at most about PIECE_ROWS of them and PIECE_BYTES.
        ``spent`` is the written table behind df, deleted as soon as it isn't read any more."""
        from pyspark.sql import functions as F

        step, most = max(bits - 16, 0), min(PIECE_ROWS, PIECE_BYTES // (8 + 4 * len(values)))
        spark, values = df.sparkSession, [F.col(v).cast("float") for v in values]
        df = df.select(F.col(key).cast("long").alias("key"), *values)
        n, cuts, piece, held = df.count() if bits > 16 else 0, [], [], 0
        if n > most:
            for b, m in sorted(tuple(r) for r in df.groupBy(F.shiftright("key", step).alias("b")).count().toLocalIterator()):
                if held and held + m > most:
                    cuts.append(b << step)
                    held = 0
                held += m
                piece.append((b, len(cuts)))
        edges = [-(1 << 63), *cuts, 1 << 63]
        ranges = [(lo, hi - 1) for lo, hi in zip(edges, edges[1:])]
        if cuts:  # each range is read alone
            if len(cuts) < PIECES_BY_TASK:
                at = F.array(*[F.lit(c).cast("long") for c in cuts])
                dealt = df.withColumn("__piece", F.size(F.filter(at, lambda c: c <= F.col("key"))))
            else:  # an Arrow table stays in the JVM: no task makes its rows
                at = spark.createDataFrame(pa.table({"__b": [b for b, _ in piece], "__piece": pa.array([i for _, i in piece], pa.int32())}))
                dealt = df.join(F.broadcast(at), F.shiftright("key", step) == F.col("__b")).drop("__b").repartition("__piece")
            whole = table(dealt, "pieces", by="__piece")
            if spent is not None:
                drop(spent)
        shared = []
        for i, (lo, hi) in enumerate(ranges):
            shared.append((lo, hi, cls._sent(spark.sparkContext, whole.filter(F.col("__piece") == i).drop("__piece") if cuts else df)))
            if cuts:
                _delete(spark, f"{whole._tidemill_path}/__piece={i}")
            pa.default_memory_pool().release_unused()
            collect_garbage(spark)
        if cuts:
            drop(whole)
        elif spent is not None:
            drop(spent)
        return cls(owner, shared)

    @classmethod
    def _sent(cls, sc, part):
        """A broadcast of the sorted keys and their values, which the driver itself doesn't hold."""
        t = part.toArrow()
        k = t.column(0).to_numpy()
        order = np.argsort(k)
        k = k[order]
        v = np.empty((len(k), t.num_columns - 1), np.float32)
        for i in range(v.shape[1]):
            v[:, i] = t.column(i + 1).to_numpy()[order]
        del t, order  # the driver holds the table once, not twice
        sent = sc.broadcast((k, cls._packed(v)))
        if hasattr(sent, "_value"):
            del sent._value
        return sent

    @staticmethod
    def _packed(values: np.ndarray):
        """Rows of values as codes of the different ones, if those are few."""
        if values.shape[1] > 1 and len(values):
            name = np.zeros(len(values), U64)
            for column in values.T:
                name = mix(name * U64(_ODD) ^ column.astype(np.float32).view(np.uint32).astype(U64))
            _, at, codes = np.unique(name, return_index=True, return_inverse=True)
            if len(at) <= 1 << 16:
                codes, some = codes.astype(np.uint16), values[at]
                if all(np.array_equal(some[codes, i], values[:, i]) for i in range(values.shape[1])):
                    return codes, some
        return None, values

    @staticmethod
    def _rows(packed, at: np.ndarray) -> np.ndarray:
        codes, values = packed
        return values[at] if codes is None else values[codes[at]]

    @property
    def many(self) -> bool:
        return len(self.shared) > 1

    def find(self, keys: list[np.ndarray], blank: float) -> list[np.ndarray]:
        """The values of each array of keys (signed), ``blank`` where the table hasn't a key;
        one number a key if the table has one column of values."""
        return list(self.each(keys, blank))

    def each(self, keys: list[np.ndarray], blank: float) -> Iterator[np.ndarray]:
        """As ``find``, one array of keys after another; of several pieces it holds the values of different keys once."""
        if not self.many:
            held = only(self.owner, dict)
            if self.name not in held:
                held[self.name] = taken(self.shared[0][2])
            have, values = held[self.name]
            for k in keys:
                o = np.full((len(k), values[1].shape[1]), blank, np.float32)
                if len(have):
                    at = np.searchsorted(have, k)
                    at[at == len(have)] = 0
                    hit = have[at] == k
                    o[hit] = self._rows(values, at[hit])
                yield o[:, 0] if o.shape[1] == 1 else o
            return
        # ascending keys meet each piece once, and in the order of its own
        bounds = np.cumsum([0, *map(len, keys)])
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat)
        flat = flat[order]
        new = np.r_[True, flat[1:] != flat[:-1]][: len(flat)]
        which = np.empty(len(flat), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        flat, out = flat[new], None
        for lo, hi, shared in self.shared:
            have, values = taken(shared)
            if out is None:
                out = np.full((len(flat), values[1].shape[1]), blank, np.float32)
            first, last = np.searchsorted(flat, lo), np.searchsorted(flat, hi, "right")
            if len(have) and last > first:
                at = np.searchsorted(have, flat[first:last])
                at[at == len(have)] = 0
                hit = have[at] == flat[first:last]
                out[first:last][hit] = self._rows(values, at[hit])
            del have, values  # before the next is loaded
        for lo, hi in zip(bounds, bounds[1:]):
            o = out[which[lo:hi]]
            yield o[:, 0] if o.shape[1] == 1 else o


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random 64-bit value for each byte, from a rule.
BYTE_KEYS = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
BYTE_KEYS_LOWER = BYTE_KEYS[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, U64(_ODD)), np.full(size, U64(_INV))
        up[0] = down[0] = U64(1)
        up, down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 4 * BLOCK_BYTES:
            return up[:n], down[:n]
        _powers["up"], _powers["down"] = up, down
    return _powers["up"][:n], _powers["down"][:n]


#: Polynomials modulo 2**64 collide on crafted strings of some hundred bytes: longer spans are hashed by xxh3.
POLYNOMIAL_BYTES = 64


class SpanHash:
    """64-bit hashes of arbitrary spans of one byte array: O(1) each up to ``POLYNOMIAL_BYTES``,
    beyond that of all the span's bytes."""

    def __init__(self, data: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> None:
        up, self.down = powers(len(data) + 1)
        self.data, self.fold = data, keys is BYTE_KEYS_LOWER
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(keys[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if len(size) and size.min() > POLYNOMIAL_BYTES:
            return self._whole(starts, ends)
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h = mix(h ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))
        large = np.flatnonzero(size > POLYNOMIAL_BYTES)
        if len(large):
            h[large] = self._whole(starts[large], ends[large])
        return h

    def _whole(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = memoryview(np.ascontiguousarray(LOWER[self.data] if self.fold else self.data))
        of = xxhash.xxh3_64_intdigest
        return np.fromiter((of(raw[a:b], 7) for a, b in zip(starts.tolist(), ends.tolist())), U64, len(starts))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two hashes."""
    return mix(a * U64(0x9FB21C651E98DF25) + mix(b ^ U64(0xA0761D6478BD642F)))


# ---------------------------------------------------------------- blocks

@dataclass
class Block:
    """Texts first..last of a batch: their bytes, and the offset of each (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(off, off[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first])
        first = last


@dataclass
class Words:
    """Word spans of a block; ``bounds[i]:bounds[i+1]`` are the words of text i."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(block: Block, space: np.ndarray = SPACE) -> Words:
    """Runs of bytes that `space` doesn't mark."""
    solid = ~space[block.data]
    n = len(solid)
    before = np.empty(n, bool)
    before[1:] = solid[:-1]
    cuts = block.offsets[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[:-1] = solid[1:]
    last = block.offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


def windows(counts: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window of ``width`` words that lies in one text."""
    m = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(m)), m)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[:-1], m)
    return first, owner


#: Letters, digits and all bytes over 127 make plain words; other bytes part them.
PLAIN_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def long_array(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``flat[bounds[i]:bounds[i+1]]`` as one binary value for each i (bounds in items)."""
    off = (bounds * flat.itemsize).astype(np.int64)
    off = off - off[0]
    body = np.ascontiguousarray(flat[bounds[0] : bounds[-1]])
    arr = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())])
    return arr.cast(pa.binary())


# ---------------------------------------------------------------- Spark

def grouped(batches, size: int):
    """Batches put together until they hold ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield from joined(held)
            held, n = [], 0
    yield from joined(held)


def joined(batches: list[pa.RecordBatch]):
    return batches if len(batches) < 2 else pa.Table.from_batches(batches).combine_chunks().to_batches()


def append_columns(df, text: str, keep: list[str], fields: list[tuple[str, str]], start, extra: tuple[str, ...] = (), group: int = 0):
    """``keep`` and new columns computed from the texts, batch by batch.

    ``start()`` runs once in each task and returns a function from (text array,
    extra arrays) to the new arrays.  A new column replaces one of ``keep`` with
    the same name in any case.  With ``group`` the function gets batches of about
    so many bytes together.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    ship(df.sparkSession)
    new = {n.lower() for n, _ in fields}
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in new]
    need = list(dict.fromkeys([*keep, text, *extra]))
    at = {c: i for i, c in enumerate(need)}
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in need]
    src = df.select(*[q.alias(f"c{i}") for i, q in enumerate(quoted)])
    src = src.withColumn(f"c{at[text]}", F.col(f"c{at[text]}").cast("string"))
    made = T.StructType([T.StructField(f"c{at[c]}", src.schema[f"c{at[c]}"].dataType) for c in keep] + [T.StructField(f"n{i}", T._parse_datatype_string(t)) for i, (_, t) in enumerate(fields)])
    names, kept, ti, ex = made.names, [at[c] for c in keep], at[text], [at[c] for c in extra]

    def run(batches):
        work = start()
        for b in grouped(batches, group):
            if b.num_rows:
                made = pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *work(b.column(ti), *(b.column(i) for i in ex))], names=names)
                for i in range(0, made.num_rows, BATCH_ROWS if group else made.num_rows):
                    yield made.slice(i, BATCH_ROWS) if group else made

    out = src.mapInArrow(run, made)
    return out.select(*[F.col(f"c{at[c]}").alias(c) for c in keep], *[F.col(f"n{i}").alias(n) for i, (n, _) in enumerate(fields)])


class Tally:
    """Counts of 64-bit keys, merged now and then so that memory follows the distinct keys."""

    def __init__(self, merge_at: int = 1 << 20) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.loose, self.merge_at = 0, merge_at

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            s = np.sort(keys)
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            self.parts.append((s[at], np.diff(np.r_[at, len(s)])))
            self.loose += len(at)
            if self.loose >= self.merge_at:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            k, c = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            self.parts = [(k[at], np.add.reduceat(c, at))]
            self.loose, self.merge_at = 0, max(self.merge_at, len(at))
        return self.parts[0] if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[i]:bounds[i+1]]``; 0 where that is empty.  Equal ranges have equal sums, wherever they lie."""
    if values.dtype.kind == "f":
        out, some = np.zeros(len(bounds) - 1), np.diff(bounds) > 0
        if some.any():
            out[some] = np.add.reduceat(values[: bounds[-1]], bounds[:-1][some])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# ---------------------------------------------------------------- labels

def labels_of(labels, key: str, label: str, remainders: tuple[int, ...], most: int | None = None):
    """(__key, y): the labels (0 or 1; the greater of several) of the keys whose crc32 modulo 4 is
    one of ``remainders``; of ``most`` keys, chosen by hash, if that is given."""
    from pyspark.sql import functions as F

    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4))
    y = labels.filter(F.col(label).isin(0, 1) & fold.isin(*remainders)).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return y.orderBy(F.xxhash64("__key"), "__key").limit(most) if most else y


def labelled(docs, labels, key: str, label: str, remainders: tuple[int, ...], most: int | None = None, limit: int = 4_000_000):
    """docs with their label in column ``y``, as ``labels_of`` gives it.  The labels are broadcast if
    there are at most ``limit``; beyond that it is a plain join."""
    from pyspark.sql import functions as F

    y = table(labels_of(labels, key, label, remainders, most), "labels")
    y = F.broadcast(y) if y.count() <= limit else y
    return docs.join(y, docs[key] == y["__key"]).drop("__key")


def sample(rows, columns: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and labels of a sample (key, y, columns of numbers or of lists of them, ``width`` in all): one row a key,
    so that repeated keys can't make it larger."""
    one = rows.dropDuplicates(["key"]).toArrow()
    y = one.column("y").to_numpy().astype(np.float64)
    parts = [one.column(c).combine_chunks() for c in columns]
    flat = [p.flatten().to_numpy().reshape(len(y), -1) if pa.types.is_list(p.type) else p.to_numpy()[:, None] for p in parts] if len(y) else [np.zeros((0, width))]
    x = np.concatenate(flat, 1)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of rows
    return x[order], y[order]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on standardised columns,
    put back to the columns' own scale; the log-odds of y where it has one value or no rows."""
    n, k = x.shape if len(x) else (0, x.shape[1])
    w = np.zeros(k + 1)
    if n == 0 or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
        return w
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[(x - mean) / sd, np.ones(n)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(k + 1), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()]
