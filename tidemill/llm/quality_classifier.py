"""Quality by co-training two classifiers on separate views of a document.

The content view sees the text: its words, and how it is laid out (line and word
lengths, shares of signs, capitals, digits and repeated words) in steps.  The
metadata view sees what the page's record says beside the text: language, source
and the recorded number of characters.  Both are naive Bayes models over hashed
features whose counts Spark adds over all documents, so neither training nor
pseudo-labels are bounded by a machine.  Words share ``WORD_SLOTS`` slots.

Round by round both views score every document whose label is neither counted nor
used to calibrate; where one view's calibrated probability is beyond ``CONFIDENT``,
the *other* view counts the document under that label (at the weight ``PSEUDO``).
Calibrations are logistic regressions on at most ``CALIBRATION_ROWS`` labelled keys
whose counts are in neither model; a last one combines both views.

Defined results: a null text counts as empty and is scored by its metadata; null
language, source and size are values of their own; labels that are null or not 0 or 1
are ignored, of several for a key the greater holds; without labels of both
classes all scores are the class's share; repeated rows get equal scores; an
empty table gives an empty result; absent metadata columns count as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

WORD_SLOTS, LAYOUT_SLOTS, META_SLOTS = 1 << 20, 1 << 9, 1 << 14
ROUNDS = 2
CONFIDENT = 0.98
PSEUDO = 0.5
CALIBRATION_ROWS = 50_000
THRESHOLD = 0.5
COUNTED, CALIBRATED, HELD_OUT = (0, 1), (3,), 2
#: Columns of the ratios that each view gives.
CONTENT, METADATA = slice(0, 2), slice(2, 3)
_KIND = {name: np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for name, f in (("capital", lambda c: "A" <= c <= "Z"), ("digit", str.isdigit), ("sign", lambda c: not c.isalnum() and not c.isspace()))}


def _steps(x: np.ndarray, n: int) -> np.ndarray:
    return np.minimum((x * n).astype(np.int64), n - 1)


def words_of(block: A.Block) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of each text (a word counts once a text), and bounds."""
    words = A.words_of(block, A.PLAIN_SPACE)
    slot = (A.SpanHash(block.data, A.BYTE_KEYS_LOWER)(words.starts, words.ends) % np.uint64(WORD_SLOTS)).astype(np.int64)
    both = np.unique(words.owner() * WORD_SLOTS + slot)
    return both % WORD_SLOTS, np.searchsorted(both, np.arange(len(block) + 1) * WORD_SLOTS)


def layout_of(block: A.Block) -> np.ndarray:
    """(texts, features): the slot of each step of a text's layout."""
    n = np.maximum(block.sizes, 1)
    words = A.words_of(block)
    count = np.maximum(words.counts, 1)
    lines = A.sum_by((block.data == 10).view(np.int8), block.offsets) + 1
    share = {k: A.sum_by(v[block.data].view(np.int8), block.offsets) / n for k, v in _KIND.items()}
    h = A.SpanHash(block.data)(words.starts, words.ends)
    same = A.repeated(A.pair(h, words.owner().astype(np.uint64)))
    again = A.sum_by(same.view(np.int8), words.bounds) / count
    length = A.sum_by(words.ends - words.starts, words.bounds) / count
    steps = [_steps(np.log2(n) / 32, 64), _steps(np.log2(count / lines + 1) / 16, 48), _steps(length / 24, 48), _steps(np.log2(lines) / 16, 32), *(_steps(np.sqrt(share[k]), 24) for k in ("capital", "digit", "sign")), _steps(again, 20)]
    return np.stack([v + 64 * i for i, v in enumerate(steps)], 1)


def metadata_of(lang: list, source: list, size: list) -> np.ndarray:
    """(pages, features): the slots of a page's language, source and size (in half octaves)."""
    octave = [None if x is None else int(2 * np.log2(max(x, 0) + 1)) for x in size]
    named = [[zlib.crc32(f"{k}={x}".encode()) % META_SLOTS for x in v] for k, v in (("lang", lang), ("source", source), ("size", octave), ("both", zip(lang, octave)))]
    return np.array(named, np.int64).reshape(4, -1).T


class View:
    """Naive Bayes over counts (2, slots) of documents that hold a slot."""

    def __init__(self, counts: np.ndarray) -> None:
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        # slots that neither class has tell nothing
        self.ratio = np.where(counts.sum(0) > 0, np.log(p[1]) - np.log(p[0]), 0.0).astype(np.float32)


Views = tuple[View, View, View]


def _edges() -> np.ndarray:
    """Where the slots of words, layout and metadata begin and end."""
    return np.cumsum([0, WORD_SLOTS, LAYOUT_SLOTS, META_SLOTS])


def _facts(block: A.Block, lang: list, source: list, size: list):
    return (*words_of(block), layout_of(block), metadata_of(lang, source, size))


def _ratios(facts, views: Views) -> np.ndarray:
    """Mean log-ratio of the words, sums of the layout's and of the metadata's."""
    words, bounds, layout, meta = facts
    n = np.maximum(np.diff(bounds), 1)
    return np.stack([A.sum_by(views[0].ratio[words].astype(np.float64), bounds) / n, views[1].ratio[layout].sum(1), views[2].ratio[meta].sum(1)], 1)


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _columns(docs: DataFrame, key: str, text: str, lang: str, source: str, size: str) -> DataFrame:
    have = {c.lower(): c for c in docs.columns}
    of = lambda c, kind: (F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(kind)
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), of(lang, "string").alias("l"), of(source, "string").alias("s"), of(size, "long").alias("n"))


def _counts(docs: DataFrame, decide) -> np.ndarray:
    """Sums over all documents of the counts of all features: (2 classes, slots).

    docs: t, l, s, n and what else ``decide(batch, block, facts)`` needs, which gives the class
    under which the content and the metadata view count each text, or -1."""
    edges = _edges()

    def run(batches):
        total = np.zeros((2, edges[-1]), np.int64)
        for b in batches:
            meta = [b.column(i).to_pylist() for i in (1, 2, 3)]
            for block in A.text_blocks(b.column(0)):
                facts = _facts(block, *(m[block.first : block.last] for m in meta))
                for_content, for_meta = decide(b, block, facts)
                words, bounds, layout, pages = facts
                of_word = np.repeat(for_content, np.diff(bounds))
                for c in (0, 1):
                    for i, slots in enumerate((words[of_word == c], layout[for_content == c].ravel(), pages[for_meta == c].ravel())):
                        total[c, edges[i] : edges[i + 1]] += np.bincount(slots, minlength=edges[i + 1] - edges[i])
        c, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[c, slot])], names=["c", "slot", "n"])

    got = docs.mapInArrow(run, "c int, slot int, n long").groupBy("c", "slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, edges[-1]))
    out[got.column("c").to_numpy(), got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _views(counts: np.ndarray) -> Views:
    edges = _edges()
    return tuple(View(counts[:, a:b]) for a, b in zip(edges, edges[1:]))


def _with_ratios(docs: DataFrame, views: Views, keep: list[str], weights=None) -> DataFrame:
    """keep and the views' ratios, or their calibrated probabilities and the combined score."""
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def start():
        def work(text, lang, source, size):
            x = np.concatenate([_ratios(_facts(b, *(c.slice(b.first, len(b)).to_pylist() for c in (lang, source, size))), shared.value) for b in A.text_blocks(text)])
            if weights is None:
                return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 3).cast(pa.list_(pa.float64()))]
            return [pa.array(_probability(weights[2], x)), pa.array(_probability(weights[0], x[:, CONTENT])), pa.array(_probability(weights[1], x[:, METADATA]))]

        return work

    fields = [("ratios", "array<double>")] if weights is None else [(f, "double") for f in ("score", "content_score", "metadata_score")]
    return A.append_columns(docs, "t", keep, fields, start, ("l", "s", "n"))


def _calibrate(some: DataFrame, views: Views) -> list[np.ndarray]:
    """Weights for the content view, the metadata view and both."""
    x, y = A.sample(_with_ratios(some, views, ["key", "y"]), ["ratios"], 3)
    return [A.logistic(x[:, CONTENT], y), A.logistic(x[:, METADATA], y), A.logistic(x, y)]


def _given(b, block, facts):
    y = b.column(4).to_numpy()[block.first : block.last]
    return y, y


def _exchange(views: Views, weights: list[np.ndarray], facts) -> tuple[np.ndarray, np.ndarray]:
    """The class that each view learns for each text from the *other* view, or -1."""
    x, sure = _ratios(facts, views), []
    for w, own in zip(weights, (CONTENT, METADATA)):
        p = _probability(w, x[:, own])
        sure.append(np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1)))
    return sure[1], sure[0]


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", lang: str = "lang", source: str = "source", size: str = "n_chars", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, score, predicted, content_score and metadata_score of every row."""
    A.ship(docs.sparkSession)
    rows = _columns(docs, key, text, lang, source, size)
    named = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
    some = A.labelled(rows, named, "key", "label", CALIBRATED, CALIBRATION_ROWS)
    known = _counts(A.labelled(rows, named, "key", "label", COUNTED).select("t", "l", "s", "n", "y"), _given)
    views = _views(known)
    weights = _calibrate(some, views)
    # pseudo-labels go to documents whose label is neither counted nor used to calibrate
    used = A.table(A.labels_of(named, "key", "label", COUNTED).union(A.labels_of(named, "key", "label", CALIBRATED, CALIBRATION_ROWS)).select(F.col("__key").alias("key")), "used")
    free = rows.join(F.broadcast(used) if used.count() <= 4_000_000 else used, "key", "left_anti").select("t", "l", "s", "n")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((views, weights))
        views = _views(known + PSEUDO * _counts(free, lambda b, block, facts, shared=shared: _exchange(*shared.value, facts)))
        weights = _calibrate(some, views)
    out = _with_ratios(rows, views, ["key"], weights)
    held = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(4)) == HELD_OUT
    return out.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "content_score", "metadata_score")
