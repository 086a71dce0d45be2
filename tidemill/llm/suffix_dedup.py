"""Repeated passages by an enhanced suffix array.

A passage is a string of ``length`` bytes that starts at two places or more.  Every
window of that many bytes is anchored at the place in it whose next ``GRAM``
bytes hash lowest (leftmost at ties), which depends on its bytes alone, so equal
windows have equal anchors and the texts need no more than their anchors' keys
to find each other:

1. anchors: key (hash of the gram) and a hash of the context, the bytes to the
   left and right that any window of the anchor can reach; keys seen once go;
2. a context seen twice covers itself; nothing more needs to be known of it;
3. keys with different contexts: the suffixes from the anchor on, sorted with
   their common prefixes, are an enhanced suffix array in which a stack scan finds
   the common-prefix intervals.  Within an interval (prefix r) the members' left
   extensions are sorted too; where they differ, the interval is a maximal repeat
   and each member's longest common extension l with another gives the repeat of
   l + r bytes around its anchor, reported for all occurrences.

A key with more than ``TREE_CONTEXTS`` different contexts (a passage that a large
share of all texts hold) isn't gathered: its windows are hashed one by one and
counted, before the shuffle already, which is exact as well and grows with the
rows only.  ``groups`` returns the maximal repeats with all their occurrences, those of
equal contexts among them; ``cut`` needs no more than what they cover, so that it
takes a member's longest repeats alone and leaves equal contexts to their hashes.

Defined results: a null text counts as empty; texts shorter than ``length`` have
nothing removed; equal texts (in any rows, whatever their keys) remove each other; matches never
cross texts; judged on the input, not on what is left; an empty table gives an
empty result.  Cuts may lie inside a character: ``kept`` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

LENGTH = 400
GRAM = 32
TREE_CONTEXTS = 32_768
#: A context or window that holds more than one of so many rows is spread over tasks; there are fewer of them than this.
HOT_SHARE = 2_000
#: Rows of such a key that one task joins, about.
HOT_ROWS = 4_096


def anchors(block: A.Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, A.SpanHash]:
    """Anchors of the block's windows: text, place in the block, key."""
    spans = A.SpanHash(block.data)
    gram = min(GRAM, length)
    m = len(block.data) - length + 1
    none = np.zeros(0, np.int64)
    if m <= 0 or not (block.sizes >= length).any():
        return none, none, none.astype(np.uint64), spans
    at = np.arange(len(block.data) - gram + 1)
    keys = spans(at, at + gram)
    low = (keys & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: m], low[width - step :][:m])
    chosen = (low[:m] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(m + 1, np.int64)
    long_ = block.sizes >= length
    np.add.at(inside, block.offsets[:-1][long_], 1)
    np.add.at(inside, block.offsets[1:][long_] - length + 1, -1)
    chosen = np.unique(chosen[np.cumsum(inside[:m]) > 0])
    return np.searchsorted(block.offsets, chosen, "right") - 1, chosen, keys[chosen], spans


def _reach(block: A.Block, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte that a window of the anchor can hold."""
    return np.maximum(at - (length - min(GRAM, length)), block.offsets[text]), np.minimum(at + length, block.offsets[text + 1])


def _name(text):
    """Two chained 64-bit hashes name a text."""
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """h, g, pos, key, ctx of every anchor of every row."""

    def run(batches):
        for b in batches:
            h, g = b.column(1).to_numpy(), b.column(2).to_numpy()
            for block in A.text_blocks(b.column(0)):
                text, at, key, spans = anchors(block, length)
                if len(at):
                    lo, hi = _reach(block, text, at, length)
                    # where the context is cut by the text's ends is a part of it
                    ctx = A.pair(spans(lo, hi), (at - lo).astype(np.uint64))
                    row = block.first + text
                    yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(g[row]), pa.array(at - block.offsets[text]), A.long_array(key), A.long_array(ctx)], names=["h", "g", "pos", "key", "ctx"])

    return texts.select("t", "h", "g").mapInArrow(run, "h long, g long, pos long, key long, ctx long")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """key, ctx, lft (the bytes left of the anchor, backwards) and rgt (those from it on) of
    the wanted anchors (h, g, pos, key, ctx)."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = t.encode()
                for w in want:
                    p = w["pos"]
                    for o, x in zip(out, (w["key"], w["ctx"], raw[max(0, p - length + min(GRAM, length)) : p][::-1], raw[p : p + length])):
                        o.append(x)
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["key", "ctx", "lft", "rgt"])
                    out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["key", "ctx", "lft", "rgt"])

    lists = wanted.groupBy("h", "g").agg(F.collect_list(F.struct("pos", "key", "ctx")).alias("want"))
    one = texts.dropDuplicates(["h", "g"])
    return one.join(lists, ["h", "g"]).select("t", "want").mapInArrow(run, "key long, ctx long, lft binary, rgt binary")


class Suffixes:
    """Bytes of many rows as padded matrices, and common prefixes of rows."""

    def __init__(self, column: pa.Array, width: int) -> None:
        off = column.buffers()[1]
        off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.sizes = np.diff(off)
        self.bytes = np.zeros((len(column), width + 1), np.uint8)
        inside = np.arange(width + 1) < self.sizes[:, None]
        self.bytes[inside] = raw[off[0] : off[-1]]

    def part(self, first: int, n: int) -> Suffixes:
        """n rows from the first on."""
        got = object.__new__(Suffixes)
        got.sizes, got.bytes = self.sizes[first : first + n], self.bytes[first : first + n]
        return got

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of rows i and j; the end of a row equals nothing."""
        out = np.zeros(len(i), np.int64)
        for s in range(0, len(i), 4096):
            a, b = i[s : s + 4096], j[s : s + 4096]
            differ = self.bytes[a] != self.bytes[b]
            differ[:, -1] = True
            out[s : s + 4096] = np.minimum(differ.argmax(1), np.minimum(self.sizes[a], self.sizes[b]))
        return out


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (prefix, first, last) of a suffix array by one stack scan;
    ``lcp[i]`` is the prefix that suffixes i and i + 1 share."""
    found, stack = [], [(0, 0)]
    for i, v in enumerate([*lcp, 0]):
        first = i
        while stack[-1][0] > v:
            depth, first = stack.pop()
            found.append((depth, first, i))
        if stack[-1][0] < v:
            stack.append((v, first))
    return found


def repeats(lcp: np.ndarray, left: Suffixes, rows: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, bytes left of the anchor, bytes right of it) of the repeats of one key.

    ``rows`` are in the order of their suffixes; an interval counts where its
    prefix and a member's longest left extension shared with another member make
    ``length`` bytes.
    """
    out = []
    order = np.array(sorted(range(len(rows)), key=lambda k: left.bytes[rows[k], : left.sizes[rows[k]]].tobytes()))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    for depth, first, last in intervals(lcp.tolist()):
        member = np.arange(first, last + 1)
        member = member[np.argsort(rank[member])]
        near = left.common(rows[member[:-1]], rows[member[1:]])
        if near.max(initial=0) + depth < length:
            continue
        # neighbours in the order of left extensions share the most
        most = np.maximum(np.r_[near, 0], np.r_[0, near])
        good = most + depth >= length
        out += zip(rows[member[good]].tolist(), most[good].tolist(), [depth] * int(good.sum()))
    return out


def repeat_groups(lcp: np.ndarray, left: Suffixes, length: int) -> list[tuple[int, int, int]]:
    """(row, bytes left of the anchor, bytes right of it) of every member of every maximal repeat
    of one key's contexts, whose suffixes are in order: the intervals of common prefixes, and within
    each those of common left extensions; where the extensions differ a repeat can't be longer."""
    out = []
    order = np.array(sorted(range(len(lcp) + 1), key=lambda k: left.bytes[k, : left.sizes[k]].tobytes()))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for depth, first, last in intervals(lcp.tolist()):
        member = np.arange(first, last + 1)
        member = member[np.argsort(rank[member])]
        near = left.common(member[:-1], member[1:])
        for l, i, j in [*intervals(near.tolist()), *([(0, 0, len(near))] if near.min() == 0 else [])]:
            if l + depth >= length:
                out += [(m, l, depth) for m in member[i : j + 1].tolist()]
    return out


def _named(left: Suffixes, right: Suffixes, i: np.ndarray, l: np.ndarray, r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of repeats of l bytes left of their anchor and r right of it: hashes of their strings, and whether
    a window inside chooses the anchor, so that every occurrence has it.  What the anchor's reach
    cuts from a longer repeat need not; windows of the rest choose other anchors."""
    strings = [left.bytes[k, :a][::-1].tobytes() + right.bytes[k, :b].tobytes() for k, a, b in zip(i.tolist(), l.tolist(), r.tolist())]
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))
    own = np.zeros(len(strings), bool)
    for first in range(0, len(strings), 1024):
        part = strings[first : first + 1024]
        block = A.Block(0, len(part), np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(x) for x in part])])
        text, at, _, _ = anchors(block, length)
        own[first + text[at - block.offsets[text] == l[first + text]]] = True
    return names, own


def _covered(contexts: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """key, ctx, l, r, name: repeats around anchors, from contexts partitioned by key and sorted by
    suffix.  With ``whole`` all members of all maximal repeats, named by their strings (and
    contexts that are a row twice as repeats of their own: column n); else each member's
    longest ones, without names."""

    def work(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        key, ctx = t.column(0).to_numpy(), t.column(1).to_numpy()
        left, right = (Suffixes(t.column(c).chunk(0), length) for c in (2, 3))
        n = len(key)
        same = key[1:] == key[:-1]
        pairs = np.flatnonzero(same)
        lcp = np.zeros(max(n - 1, 0), np.int64)
        lcp[pairs] = right.common(pairs, pairs + 1)
        starts = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[starts, n])
        if whole:
            # a context that several places hold is a repeat itself
            own = np.flatnonzero((t.column(4).to_numpy() > 1) & (left.sizes + right.sizes >= length))
            rows, ls, rs = [own], [left.sizes[own]], [right.sizes[own]]
        else:
            two = starts[sizes == 2]
            ext = left.common(two, two + 1)
            hit = ext + lcp[two] >= length
            rows = [np.r_[two[hit], two[hit] + 1]]
            ls, rs = [np.r_[ext[hit], ext[hit]]], [np.r_[lcp[two][hit], lcp[two][hit]]]
        for s, m in zip(starts[sizes > 2 - whole].tolist(), sizes[sizes > 2 - whole].tolist()):
            got = [(s + i, a, b) for i, a, b in repeat_groups(lcp[s : s + m - 1], left.part(s, m), length)] if whole else repeats(lcp[s : s + m - 1], left, np.arange(s, s + m), length)
            if got:
                i, a, b = (np.array(x, np.int64) for x in zip(*got))
                rows.append(i), ls.append(a), rs.append(b)
        i, l, r = np.concatenate(rows), np.concatenate(ls), np.concatenate(rs)
        if not len(i):
            return None
        name = pa.nulls(len(i), pa.int64())
        if whole:
            name, own = _named(left, right, i, l, r, length)
            i, l, r, name = i[own], l[own], r[own], A.long_array(name[own])
        return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(ctx[i]), pa.array(l), pa.array(r), name], names=["key", "ctx", "l", "r", "name"])

    def run(batches):
        rest = None
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                b = pa.Table.from_batches([batch.slice(i, 2048)])
                t = pa.concat_tables([rest, b]) if rest is not None else b
                keys = t.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                rest = t.slice(cut)
                if cut:
                    got = work(t.slice(0, cut))
                    if got is not None:
                        yield got
        if rest is not None:
            got = work(rest)
            if got is not None:
                yield got

    return contexts.mapInArrow(run, "key long, ctx long, l long, r long, name long")


def _anchored(docs: DataFrame, text: str, length: int):
    """texts (t, h, g of every row); rows (key, ctx, h, g, pos, m: anchors of keys seen twice or more); by_ctx
    (key, ctx, n and one place of each context); kinds (key, kinds: different contexts, two or more)."""
    A.ship(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(t.alias("t"), *_name(t))
    rows = _anchor_rows(texts, length).groupBy("key", "ctx", "h", "g", "pos").agg(F.count(F.lit(1)).alias("m"))
    every = A.table(rows, "anchors")
    # written tables below leave Spark free to split what a common key or context holds
    seen = A.table(every.groupBy("key").agg(F.sum("m").alias("all")).filter("all > 1").select("key"), "keys")
    rows = A.table(every.join(seen, "key", "left_semi"), "anchors")
    A.drop(every, seen)
    by_ctx = A.table(rows.groupBy("key", "ctx").agg(F.sum("m").alias("n"), F.min(F.struct("h", "g", "pos")).alias("r")), "contexts")
    kinds = A.table(by_ctx.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    return texts, rows, by_ctx, kinds


def _in_order(contexts: DataFrame) -> DataFrame:
    """The enhanced suffix arrays' order: each key's contexts by suffix."""
    parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return contexts.repartition(parts, "key").sortWithinPartitions("key", "rgt", "lft")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """name, key, begin, end: maximal repeats of ``length`` bytes or more with all of their occurrences.

    A repeat is as long as all its occurrences allow within the reach of an anchor (``length``
    bytes on either side); a longer passage is several overlapping repeats.  Around keys of more
    than ``TREE_CONTEXTS`` contexts the repeats are single windows.  ``name`` is a hash of the string."""
    with A.Scope() as scope:
        places = _repeats(docs, text, length)
        places = scope.keep(A.table(places, "places"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key), *_name(t)).join(places, ["h", "g"]).select("name", key, "begin", "end")


def _repeats(docs: DataFrame, text: str, length: int) -> DataFrame:
    """name, h, g, begin, end of the repeats in different texts."""
    texts, rows, by_ctx, kinds = _anchored(docs, text, length)
    some = by_ctx.join(kinds, "key", "left").filter("n > 1 or kinds > 1").select("key", "ctx", F.coalesce("kinds", F.lit(1)).alias("kinds"), "n", "r.*")
    held = _contexts(texts, some.filter(F.col("kinds") <= TREE_CONTEXTS), length).join(by_ctx.select("key", "ctx", "n"), ["key", "ctx"])
    found = A.table(_covered(_in_order(held), length, whole=True).distinct(), "repeats")
    places = A.table(rows.select("key", "ctx", "h", "g", "pos").join(found, ["key", "ctx"]).select("name", "h", "g", (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r")).alias("end")), "places")
    hot = _hot_windows(texts, some.filter(F.col("kinds") > TREE_CONTEXTS).select("key").distinct(), rows, length)
    return places.union(hot.select(F.col("w").alias("name"), "h", "g", F.col("p").alias("begin"), (F.col("p") + length).alias("end"))).distinct()


def spans_of(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts: t, h, g of every row; covered: h, g, spans of repeated passages by text)."""
    texts, rows, by_ctx, kinds = _anchored(docs, text, length)
    several = by_ctx.join(kinds, "key").select("key", "ctx", "kinds", "r.*", "n")
    tree = _covered(_in_order(_contexts(texts, several.filter(F.col("kinds") <= TREE_CONTEXTS), length)), length).drop("name")
    whole = by_ctx.filter("n > 1").select("key", "ctx", F.lit(length - min(GRAM, length)).cast("long").alias("l"), F.lit(length).cast("long").alias("r"))
    found = A.table(tree.union(whole), "repeats")
    best = A.table(found.groupBy("key", "ctx").agg(F.collect_set(F.struct("l", "r")).alias("all")), "repeats")
    at = _spread_join(rows.select("key", "ctx", "h", "g", "pos"), best, by_ctx, ["key", "ctx"])
    spans = at.select("h", "g", F.explode(F.transform("all", lambda x: _span(F.col("pos") - x["l"], x["l"] + x["r"], length))).alias("s"))
    hot = _hot_spans(texts, several.filter(F.col("kinds") > TREE_CONTEXTS).select("key").distinct(), rows, length)
    covered = spans.union(hot).groupBy("h", "g").agg(F.collect_list("s").alias("spans"))
    return texts, covered


def _span(begin, size, length: int):
    """A span as one number: its begin (``length`` bytes before the text at most) and its size."""
    return F.shiftleft((begin + length).cast("long"), 20).bitwiseOR(size.cast("long"))


def _spans(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the spans in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = column.flatten().to_numpy()
    begin = (flat >> 20) - length
    return np.repeat(np.arange(len(n)), n), begin, begin + (flat & ((1 << 20) - 1))


def _spread_join(rows: DataFrame, right: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with right (a row a key), where ``counts`` (keys and n) tells how many rows a key has.
    Rows of very common keys are dealt over salts, and their row of ``right`` goes to each."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(*keys, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    common = A.table(common, "common")  # fewer than HOT_SHARE rows
    if not common.limit(1).count():
        return rows.join(right, keys)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(common), keys, "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    return left.join(right.join(F.broadcast(common), keys, "left").withColumn("salt", copies).drop("salts"), [*keys, "salt"]).drop("salt")


def _hot_windows(texts: DataFrame, keys: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """w, h, g, p: repeated windows (hash, text, place) of the anchors of very common keys."""
    at = A.table(rows.join(keys, "key", "left_semi").groupBy("h", "g").agg(F.collect_list("pos").alias("at"), F.max("m").alias("m")), "common")
    one = texts.dropDuplicates(["h", "g"]).join(at, ["h", "g"]).select("t", "at", "m", "h", "g")

    def windows(b):
        """Of each text: hashes and places of the windows around its anchors."""
        for block in A.text_blocks(b.column(0)):
            spans = A.SpanHash(block.data)
            for k in range(len(block)):
                a = b.column(1)[block.first + k].values.to_numpy()
                reach = length - min(GRAM, length)
                p = np.unique((a[:, None] - np.arange(reach + 1)).ravel())
                p = p[(p >= 0) & (p + length <= block.sizes[k])]
                q = p + block.offsets[k]
                yield block.first + k, p, spans(q, q + length)

    def count(batches):
        tally = A.Tally()
        for b in batches:
            times = b.column(2).to_numpy()
            for row, _, w in windows(b):
                for _ in range(min(int(times[row]), 2)):
                    tally.add(w)
        keys_, counts = tally.merge()
        for i in range(0, len(keys_), 1 << 16):
            yield pa.RecordBatch.from_arrays([A.long_array(keys_[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)].astype(np.int64))], names=["w", "n"])

    def place(batches):
        for b in batches:
            h, g = b.column(3).to_numpy(), b.column(4).to_numpy()
            for row, p, w in windows(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), h[row])), pa.array(np.full(len(p), g[row])), pa.array(p), A.long_array(w)], names=["h", "g", "p", "w"])

    twice = A.table(one.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1"), "windows")
    return _spread_join(one.mapInArrow(place, "h long, g long, p long, w long"), twice.select("w"), twice, ["w"])


def _hot_spans(texts: DataFrame, keys: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """h, g, s: the spans of those windows."""
    return _hot_windows(texts, keys, rows, length).select("h", "g", _span(F.col("p"), F.lit(length), length).alias("s"))


def cut(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """``keep``, n_bytes, n_removed, n_spans and kept (binary) of every row.  With
    ``whole_characters`` a character stays unless all of its bytes are repeated,
    so that what is kept is text."""
    keep = [c for c in keep if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept")]  # results replace them
    with A.Scope() as scope:
        _, covered = spans_of(docs, text, length)
        covered = scope.keep(A.table(covered, "spans"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h, g = _name(t)
    named = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"k{i}") for i, c in enumerate(keep)], t.alias("t"), h, g).join(covered, ["h", "g"], "left")

    def start():
        def work(column, spans):
            n, gone, runs, kept = [], [], [], []
            row, begin, end = _spans(spans, length)
            for block in A.text_blocks(column):
                data, off = block.data, block.offsets
                edge = np.zeros(len(data) + 1, np.int64)
                here = slice(*np.searchsorted(row, (block.first, block.last)))
                own = row[here] - block.first
                np.add.at(edge, np.maximum(begin[here], 0) + off[own], 1)
                np.add.at(edge, np.minimum(end[here] + off[own], off[own + 1]), -1)
                out = np.cumsum(edge[:-1]) > 0
                if whole_characters and len(data):
                    char = np.cumsum((data & 0xC0) != 0x80) - 1
                    out = (np.bincount(char, out) == np.bincount(char))[char]
                first = out & ~np.r_[False, out[:-1]] if len(out) else out
                begins = off[:-1][block.sizes > 0]
                first[begins] = out[begins]
                n.append(block.sizes), gone.append(A.sum_by(out.view(np.int8), off)), runs.append(A.sum_by(first.view(np.int8), off))
                left = block.sizes - gone[-1]
                kept.append(A.binary_rows(data[~out], np.r_[0, np.cumsum(left)]))
            return [*(pa.array(np.concatenate(x).astype(np.int64)) for x in (n, gone, runs)), pa.concat_arrays(kept)]

        return work

    got = A.append_columns(named, "t", [f"k{i}" for i in range(len(keep))], [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept", "binary")], start, ("spans",))
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")
