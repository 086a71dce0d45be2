"""Byte-level BPE encoding and decoding with a rank vocabulary.

Texts are cut by the vocabulary's pattern; ranked merges are folded over the
byte arrays of distinct words (``bpe.Merges.fold``: all words of one length are
the rows of a matrix, and a step merges the lowest-ranked pair of every row),
and each text's ids are put together from its words'.  Decoding concatenates the
tokens' bytes.  ``fold_column`` is the same fold as a Spark higher-order function
with a literal rank map; the README has the figures for which it isn't the main
path.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; strings that look like special tokens are ordinary text;
repeated rows are encoded each; an empty table gives an empty result.  Columns
of the input that clash with a result column are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import bpe

def _vocabulary(content: bytes):
    vocabulary, pieces = bpe.rank_file(content)
    sizes = np.array([len(p) for p in pieces], np.int64)
    return vocabulary, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", decode: bool = False) -> DataFrame:
    """``keep`` and ids (array<int>) of every text; with ``decode`` also
    decoded (binary), made from these ids alone."""
    content = open(path, "rb").read()  # a fixed file
    shared, name = docs.sparkSession.sparkContext.broadcast(content), "ranks-" + hashlib.sha256(content).hexdigest()

    def start():
        vocabulary, body, at, sizes = A.only(name, lambda: _vocabulary(shared.value))

        def work(column):
            ids, counts, out, n_bytes = [], [], [], []
            for block in A.text_blocks(column):
                s, e, bounds = bpe.word_spans(block, blanks=True, digits_alone=False)
                flat, n = vocabulary.encode(block.data, s, e)
                ends = np.r_[0, np.cumsum(n)][bounds]
                ids.append(flat)
                counts.append(np.diff(ends))
                if decode:
                    out.append(body[bpe.spread(at[flat], sizes[flat])])
                    n_bytes.append(A.sum_by(sizes[flat], ends))
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))]
            got = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))]
            if decode:
                got.append(A.binary_rows(np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(n_bytes))]))
            return got

        return work

    return A.append_columns(docs, text, keep, [("ids", "array<int>"), *([("decoded", "binary")] if decode else [])], start)


def rank_map(path: str, buckets: int = 1 << 16) -> Column:
    """The ranks as one literal: an array of small maps by crc32 of the token,
    since a lookup in a map goes through its entries one by one."""
    maps: list[list[str]] = [[] for _ in range(buckets)]
    for line in open(path, "rb").read().splitlines():
        token, rank = base64.b64decode(line.split()[0]), int(line.split()[1])
        maps[zlib.crc32(token) % buckets].append(f'"{token.hex().upper()}":{rank}')
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(m) + "}" for m in maps) + "]"), "array<map<string,int>>")


def fold_column(word: Column, ranks: Column, buckets: int = 1 << 16) -> Column:
    """Ids of one word (binary): folds the merges, lowest rank first, over its bytes in hex."""
    rank = lambda h: ranks[F.pmod(F.crc32(F.unhex(h)), F.lit(buckets)).cast("int")][h]
    hexes = F.hex(word)
    n = F.octet_length(word)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(hexes, 2 * i - 1, F.lit(2)))

    def step(acc, _):
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))), lambda i: F.coalesce(rank(F.concat(acc[i - 1], F.coalesce(F.get(acc, i), F.lit("--")))), F.lit(2**31 - 1)))
        low = F.array_min(pairs)
        j = F.array_position(pairs, low).cast("int")
        merged = F.concat(F.slice(acc, F.lit(1), j - 1), F.array(F.concat(acc[j - 1], acc[j])), F.slice(acc, j + 2, F.size(acc)))
        return F.when((F.size(acc) < 2) | (low == 2**31 - 1), acc).otherwise(merged)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), parts, step)
    return F.transform(folded, lambda h: rank(h))
