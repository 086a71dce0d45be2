"""Packing token streams into sequences of bounded length, in order.

Each task tokenises its documents in the order in which it reads them and packs
about ``WINDOW`` tokens at a time: cuts lie at the ends of documents, after
sentences, or, inside long stretches without either, after every ``STEP``
tokens.  Dynamic programming picks the cuts that minimise padding plus a
penalty for each truncated document (smaller after a sentence).  A window's last
cut is the end of its last document.

With f(j) the least cost up to boundary j at token b(j), a sequence (i, j) pads
``max_len - (b(j) - b(i))``; so f(j) = max_len - b(j) + penalty(j) + the least
f(i) + b(i) over b(i) >= b(j) - max_len, whose minimum a monotone queue keeps:
constant time a boundary.  Sequences whose length is a power of two aren't
padded and are tried beside it.

Defined results: a null text counts as empty; every document has at least its
end id, so an empty one is a piece of one id; repeated rows are packed each;
an empty table gives an empty result.  Only the id column and the text are read.
Sequence ids are the task's number and a count within it, so a repeated task
gives the same ids.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import bpe

MAX_LEN = 2048
END_ID = 1
WINDOW = 1 << 19
STEP = 256
#: Penalties, in tokens of padding: a document cut after a sentence, or elsewhere.
AFTER_SENTENCE, ELSEWHERE = 8, 64
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


def choose_cuts(bounds: list[int], penalties: list[int], max_len: int) -> list[int]:
    """Indices into ``bounds`` (ascending token offsets from 0) of the best cuts, both ends included."""
    at = {b: i for i, b in enumerate(bounds)}
    shorter = [1 << k for k in range(max_len.bit_length() - 1) if 1 << k >= max_len // 8 and 1 << k < max_len]
    cost, back = [0] * len(bounds), [0] * len(bounds)
    queue: deque[int] = deque([0])
    value = [0] * len(bounds)  # f(i) + b(i)
    for j in range(1, len(bounds)):
        b = bounds[j]
        while bounds[queue[0]] < b - max_len:
            queue.popleft()
        i = queue[0]
        best = value[i] + max_len - b
        for k in shorter:
            h = at.get(b - k)
            if h is not None and cost[h] < best:
                i, best = h, cost[h]
        best += penalties[j]
        cost[j], back[j], v = best, i, best + b
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts = [len(bounds) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def boundaries(doc_ends: np.ndarray, stops: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Token offsets at which a cut may lie, from 0, and their penalties."""
    marks = np.unique(np.r_[0, doc_ends, stops])
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > step)
    extra = [np.arange(marks[i] + step, marks[i + 1], step) for i in wide.tolist()]
    b = np.unique(np.concatenate([marks, *extra]))
    penalty = np.full(len(b), ELSEWHERE, np.int64)
    penalty[np.searchsorted(b, stops)] = AFTER_SENTENCE
    penalty[np.searchsorted(b, np.r_[0, doc_ends])] = 0
    return b, penalty


class Encoder:
    """Ids and sentence ends of texts by a JSON vocabulary."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.vocabulary = bpe.merge_file(content)
        self.library = Tokenizer.from_str(content)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __call__(self, column: pa.Array):
        """For each block: ids, bounds by text, ends of sentences (indices of ids)."""
        texts = [_normal(t or "") for t in column.to_pylist()]
        raw = {i: t for i, t in enumerate(column.to_pylist()) if t and any(s in t for s in self.special)}
        for i in raw:
            texts[i] = ""
        for block in A.text_blocks(pa.array(texts, pa.large_string())):
            s, e, bounds = bpe.word_spans(block, blanks=False, digits_alone=True)
            flat, n = self.vocabulary.encode(block.data, s, e)
            ends = np.r_[0, np.cumsum(n)]
            stops = ends[1:][_STOPS[block.data[e - 1]]] if len(e) else np.zeros(0, np.int64)
            by_text = ends[bounds]
            if own := [i for i in raw if block.first <= i < block.last]:
                # texts with the strings of special tokens go through the library as they are
                parts, lens = [], np.diff(by_text)
                for i in range(len(block)):
                    parts.append(np.array(self.library.encode(raw[block.first + i], add_special_tokens=False).ids, np.int32) if block.first + i in raw else flat[by_text[i] : by_text[i + 1]])
                    lens[i] = len(parts[-1])
                flat, by_text, stops = np.concatenate(parts), np.r_[0, np.cumsum(lens)], np.zeros(0, np.int64)
            yield block, flat, by_text, stops


def _normal(t: str) -> str:
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
        if "Σ" in t:  # lower-cased sign by sign, not by its place in the word
            t = t.replace("Σ", "σ")
    return t.lower()


class Packer:
    """Documents in, pieces out, a window at a time."""

    def __init__(self, first_sequence: int, max_len: int) -> None:
        self.sequence, self.max_len = first_sequence, max_len
        self.reset()

    def reset(self) -> None:
        self.keys, self.ids, self.lengths, self.stops, self.total = [], [], [], [], 0

    def add(self, key, flat: np.ndarray, by_text: np.ndarray, stops: np.ndarray) -> None:
        """Texts with their keys; each gets the end id."""
        n = np.diff(by_text)
        ends = np.cumsum(n + 1)
        ids = np.full(int(ends[-1]), END_ID, np.uint32)
        ids[bpe.spread(ends - n - 1, n)] = flat
        if len(stops):
            text = np.searchsorted(by_text, stops, "left") - 1  # the text that a stop ends in
            self.stops.append(stops + text + self.total)
        self.keys.append(key)
        self.ids.append(ids)
        self.lengths.append(n + 1)
        self.total += len(ids)

    def flush(self) -> dict[str, np.ndarray] | None:
        if not self.total:
            return None
        lengths, ids = np.concatenate(self.lengths), np.concatenate(self.ids)
        doc_ends = np.cumsum(lengths)
        doc_starts = doc_ends - lengths
        b, penalty = boundaries(doc_ends, np.concatenate(self.stops) if self.stops else np.zeros(0, np.int64))
        cuts = b[choose_cuts(b.tolist(), penalty.tolist(), self.max_len)]
        begin = np.union1d(cuts[:-1], doc_starts)
        end = np.r_[begin[1:], self.total]
        doc = np.searchsorted(doc_ends, begin, "right")
        seq = np.searchsorted(cuts, begin, "right") - 1
        out = {"key": pa.concat_arrays(self.keys).take(pa.array(doc)), "start": begin - doc_starts[doc], "length": end - begin, "doc_tokens": lengths[doc], "sequence_id": self.sequence + seq, "offset": begin - cuts[seq], "ids": A.binary_rows(ids, np.r_[begin, self.total])}
        self.sequence += len(cuts) - 1
        self.reset()
        return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """One row a piece: the key, start, length, doc_tokens, sequence_id, offset
    and ids (binary: little-endian unsigned 32-bit)."""
    A.ship(docs.sparkSession)
    content = open(path, encoding="utf-8").read()  # a fixed file
    shared, name = docs.sparkSession.sparkContext.broadcast(content), "merges-" + hashlib.sha256(content.encode()).hexdigest()
    columns = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in columns), T.StructField("ids", T.BinaryType())])

    def run(batches):
        encoder = A.only(name, lambda: Encoder(shared.value))
        packer = Packer(TaskContext.get().partitionId() << 40, max_len)

        def rows():
            got = packer.flush()
            if got:
                yield pa.RecordBatch.from_arrays([got["key"], *(pa.array(got[c].astype(np.int64)) for c in columns), got["ids"]], names=["key", *columns, "ids"])

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                for block, flat, by_text, stops in encoder(part.column(1)):
                    packer.add(part.column(0).slice(block.first, len(block)), flat, by_text, stops)
                    if packer.total >= WINDOW:
                        yield from rows()
        yield from rows()

    return src.mapInArrow(run, schema).withColumnRenamed("key", key)
