"""Quality rules: countable facts of a text and the perplexity of a modified Kneser-Ney model.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` bytes (A-Z
lower-cased, white space as a space).  Workers count the n-grams of their
texts, Spark adds the counts over all documents and derives every lower order,
discounts, context masses and interpolated probabilities.  Every n-gram is kept
under all of its bytes, so the model grows with the corpus and none is dropped
or answered by another's value.  It reaches the workers as sorted arrays in key
ranges (``arrays.Pieces``), of which a worker holds one at a time.

Each language has its own band of log-perplexities, from quartiles over all of
its documents that pass the countable rules: ``q1 - SPAN * (q3 - q1)`` to
``q3 + SPAN * (q3 - q1)``.  Documents outside are rejected.

Defined results: a null text counts as empty and fails the countable rules; a
text of under ``ORDER`` bytes has no perplexity (null) and no band applies; a
null language is a language of its own; rows are judged one by one, so repeated
rows get equal results; an empty table gives an empty result.  Columns of the
input that clash with a result column are replaced by it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A

ORDER = 5
#: Bytes that go through all pieces of a large model at a time.
GROUP_BYTES = 4 << 20
#: Interquartile ranges on either side of the quartiles.
SPAN = 3.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_NORMAL = A.LOWER.copy()
_NORMAL[A.SPACE] = 32
_CHAR_START = (np.arange(256) & 0xC0) != 0x80

FACTS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint")]


def facts_of(block: A.Block) -> list[np.ndarray]:
    data, n = block.data, len(block)
    words = A.words_of(block)
    counts = words.counts
    chars = A.sum_by((_CHAR_START & ~A.SPACE)[data].view(np.int8), block.offsets)
    symbols = A.sum_by(_IS_SYMBOL[data].view(np.int8), block.offsets)
    spans = A.SpanHash(data)
    # three-word windows found twice or more in one text
    hashes = spans(words.starts, words.ends)
    first, owner = A.windows(counts, words.bounds, 3)
    covered = np.zeros(len(hashes) + 1, bool)
    if len(first):
        keys = A.pair(A.pair(hashes[first], hashes[first + 1]), A.pair(hashes[first + 2], owner.astype(np.uint64)))
        hit = first[A.repeated(keys)]
        for k in range(3):
            covered[hit + k] = True
    repeat = A.sum_by(covered[:-1].view(np.int8), words.bounds)
    # lines with a word, equal to an earlier line of the text
    is_break = data == 10
    breaks = np.flatnonzero(is_break)
    starts = np.unique(np.r_[block.offsets[:-1][block.sizes > 0], breaks + 1])
    starts = starts[starts < len(data)]
    dup = np.zeros(n, np.int64)
    if len(starts):
        text = np.searchsorted(block.offsets, starts, "right") - 1
        ends = np.minimum(np.r_[starts[1:], len(data)], block.offsets[text + 1])
        ends = ends - (is_break[np.maximum(ends - 1, 0)] & (ends > starts))
        has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        text, keys = text[has_word], A.pair(spans(starts[has_word], ends[has_word]), text[has_word].astype(np.uint64))
        if len(keys):
            order = np.argsort(keys, kind="stable")
            again = np.zeros(len(keys), bool)
            again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
            dup = np.bincount(text[again], minlength=n)
    return [counts, chars, symbols, dup, repeat]


def packed(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes up to each n-gram's end as one integer, and where they lie in one text."""
    d = _NORMAL[block.data]
    if len(d) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    two = (d[:-1].astype(np.uint16) << 8) | d[1:]
    four = (two[:-2].astype(np.uint32) << 16) | two[2:]
    keys = (d[: len(d) - 4].astype(np.uint64) << np.uint64(32)) | four[1:]
    ok = np.ones(len(keys), bool)
    for c in block.offsets[1:-1]:
        ok[max(c - ORDER + 1, 0) : c] = False
    return keys, ok


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): all n-grams of ORDER bytes of all texts and their counts."""
    A.ship(docs.sparkSession)

    def run(batches):
        tally = A.Tally()
        for b in batches:
            for block in A.text_blocks(b.column(0)):
                keys, ok = packed(block)
                tally.add(keys[ok])
        keys, counts = tally.merge()
        for i in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([A.long_array(keys[i : i + (1 << 17)]), pa.array(counts[i : i + (1 << 17)].astype(np.int64))], names=["gram", "n"])

    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    return part.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """For each order the interpolated probability of every n-gram counted, and for
    each context length the mass a context leaves to the next order: tables (key, v)
    in Spark; ``rest[0]`` is the key and mass of the empty context."""

    grams: dict[int, DataFrame]
    rest: dict[int, DataFrame | tuple[np.ndarray, np.ndarray]]

    def pieces(self) -> tuple[dict[int, A.Pieces], dict[int, A.Pieces]]:
        owner = uuid.uuid4().hex
        of = lambda tables: {n: A.Pieces.of(owner, t, 8 * n) for n, t in tables.items() if n}
        return of(self.grams), of(self.rest)

    dense = pieces


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts, discounts and probabilities of every order in Spark; the driver gets sums only."""
    level = A.table(count_grams(docs, text), "grams")
    levels = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        level = A.table(level.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
        levels[n] = level
    grams, rest, lower = {}, {}, None
    for n in range(1, ORDER + 1):
        level = levels[n]
        many = level.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (float(x or 0) for x in many)
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cut = [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / max(n1, 1)), (2, 2 - 3 * y * n3 / max(n2, 1)), (3, 3 - 4 * y * n4 / max(n3, 1)))]
        d = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        # at most 256 n-grams share a context, and as many a lower n-gram; whole numbers are summed, so that no order of rows shows
        by = Window.partitionBy("ctx")
        of = [F.sum(hit.cast("long")).over(by) * c for hit, c in zip((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), cut)]
        held = level.withColumn("ctx", F.shiftright("gram", 8)).withColumns({"total": F.sum("n").over(by).cast("double"), "freed": of[0] + of[1] + of[2]})
        held = held.select("gram", "ctx", ((F.col("n") - d) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("left"))
        if lower is None:
            p = held.withColumn("v", F.col("own") + F.col("left") / 256)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))
            p = held.withColumn("suffix", suffix).join(lower.select(F.col("key").alias("suffix"), F.col("v").alias("less")), "suffix").withColumn("v", F.col("own") + F.col("left") * F.col("less"))
        p = A.table(p.select(F.col("gram").alias("key"), "ctx", "left", "v"), "probabilities")
        grams[n] = lower = p.select("key", "v")
        rest[n - 1] = p.groupBy(F.col("ctx").alias("key")).agg(F.max("left").alias("v"))
    none = rest[0].first()
    rest[0] = np.zeros(1, np.int64), np.array([1.0 if none is None else none["v"]])
    return Model(grams, rest)


def log_perplexities(blocks: list[A.Block], grams, rest, rest0: float) -> list[np.ndarray]:
    """Mean negative log-probability a byte of each block's texts; NaN for under ORDER bytes."""
    keys, logs, open_, share = [], [], [], []
    for b in blocks:
        k, ok = packed(b)
        at = np.flatnonzero(ok)
        keys.append(k[at].view(np.int64))
        logs.append(np.zeros(len(k)))
        open_.append(at)
        share.append(np.ones(len(at)))
    # an n-gram that wasn't counted gets what its context leaves of the n-gram a byte shorter
    for n in range(ORDER, 0, -1):
        if not any(map(len, keys)):
            break
        for i, p in enumerate(grams[n].find(keys, 0.0)):
            hit = p > 0
            logs[i][open_[i][hit]] = np.log(share[i][hit] * p[hit])
            keys[i], open_[i], share[i] = keys[i][~hit], open_[i][~hit], share[i][~hit]
        if n > 1:
            masses = rest[n - 1].find([k >> 8 for k in keys], 1.0)
            share = [s * m for s, m in zip(share, masses)]
            keys = [k & ((1 << (8 * (n - 1))) - 1) for k in keys]
    out = []
    for b, v, at, s in zip(blocks, logs, open_, share):
        v[at] = np.log(s * rest0 / 256)
        # the n-gram at byte i judges byte i + ORDER - 1
        n = np.maximum(b.sizes - ORDER + 1, 0)
        total = np.r_[0.0, np.cumsum(v)]
        first = np.minimum(b.offsets[:-1], len(v))
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(np.where(n > 0, (total[first] - total[np.minimum(first + n, len(v))]) / n, np.nan))
    return out


def log_perplexity(block: A.Block, grams, rest, rest0: float) -> np.ndarray:
    return log_perplexities([block], grams, rest, rest0)[0]


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep``, the facts, base_failed, log_perplexity and the language's key."""
    (grams, rest), rest0 = model.pieces(), float(model.rest[0][1][0])

    def start():
        def work(column):
            blocks = list(A.text_blocks(column))
            facts = [facts_of(b) for b in blocks]
            # a model of several pieces goes over all blocks once, or else each block on its own needs less memory
            parts = [blocks] if grams[ORDER].many else [[b] for b in blocks]
            v = np.concatenate([x for p in parts for x in log_perplexities(p, grams, rest, rest0)])
            return [*(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*facts)), pa.array(v, mask=np.isnan(v))]

        return work

    got = A.append_columns(docs, text, list(dict.fromkeys([*keep, lang])), [*FACTS, ("log_perplexity", "double")], start, group=GROUP_BYTES if grams[ORDER].many else 0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def bands(scored: DataFrame, lang: str = "lang") -> DataFrame:
    """(band_lang, low, high) of each language: exact quartiles of thousandths."""
    hist = scored.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy(F.coalesce(F.col(lang), F.lit("")).alias("band_lang"), F.floor(F.col("log_perplexity") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("band_lang")
    hist = hist.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    q = hist.groupBy("band_lang").agg(*[F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bin"))).alias(f"q{k}") for k in (1, 3)])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(1)) * SPAN
    return q.select("band_lang", ((F.col("q1") - spread) / 1000).alias("low"), ((F.col("q3") + 1 + spread) / 1000).alias("high"))


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep``, lang, the facts, base_failed, log_perplexity, low, high and kept for every row."""
    keep = [c for c in keep if c.lower() not in ("base_failed", "low", "high", "kept")]  # results replace them
    with A.Scope() as scope:
        scored = scope.keep(A.table(score(docs, fit(docs, text), keep, text, lang), "quality"))
    limits = A.table(bands(scored, lang).coalesce(1), "bands").toDF("__band", "__low", "__high")  # a row a language; Spark broadcasts it by its size
    out = scored.withColumn("__of", F.coalesce(F.col(lang), F.lit(""))).join(limits, F.col("__of") == F.col("__band"), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("__low"), F.col("__high")), F.lit(True))
    return out.withColumns({"low": F.col("__low"), "high": F.col("__high"), "kept": ~F.col("base_failed") & inside}).drop("__of", "__band", "__low", "__high")
