"""Toxicity by class-conditional Kneser-Ney models of words.

For the toxic and the ordinary class there is a word-pair model

    p_c(w | v) = (1 - S) * (n_c(v w) - D_c) / n_c(v) + S * (n(v w) - D) / n(v) + rest_c(v) * p_c(w)
    rest_c(v) = (1 - S) * D_c * k_c(v) / n_c(v) + S * D * k(v) / n(v)
    p_c(w) = (1 - S) * (t_c(w) - E_c) / sum + S * t(w) / T

n counts pairs, k a word's different followers, t the different words before a
word; with the index c in one class, without it in both.  The absolute discounts
D and E come from counts of counts.  The counts without index are the shared
backoff (weight S): an expression too rare for its class to tell moves both
likelihoods alike, and where a class hasn't a context the shared counts stand for
it alone.

A text's log-likelihoods are compared per word, for p_c(w | v) and for the lower
order p_c(w): the mean log-ratio, and, since a few expressions make a text toxic
whatever its length, the mean of what exceeds ``EXCESS`` and the share of such
words.  A logistic regression on these and the length, fitted on at most ``CALIBRATION_ROWS`` labelled keys whose
counts aren't in the models, turns them into a score.

Counting, discounts and context masses are Spark aggregations over all labelled
texts.  All words, contexts and pairs are kept under their full 64-bit hashes, so
the models grow with the labelled texts.  They reach the workers as sorted arrays in
key ranges (``arrays.Pieces``), of which a worker holds one of each table at a time;
above ``MODEL_ROWS`` pairs more text goes through them at once.  Tables on disk follow
the model, never the texts' pairs.

Defined results: a null text counts as empty; a text without words has the
ratios 0; labels that are null or not 0 or 1 are ignored, of several for a key
the greater holds; without labels of both classes all scores are the class's
share; repeated rows get equal scores; an empty table gives an empty result.
Columns of ``keep`` that clash with a result column are replaced by it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Bytes that go through all pieces of large models at a time, and of those above MODEL_ROWS pairs.
GROUP_BYTES, LARGE_GROUP_BYTES = 4 << 20, 8 << 20
#: Different pairs that a task gathers before it sends them on.
COUNT_ROWS = 1 << 19
#: Above this many pairs a worker takes LARGE_GROUP_BYTES at a time, as each time loads the whole model.
MODEL_ROWS = 16_000_000
SHARED = 0.5
EXCESS = 1.5
CALIBRATION_ROWS = 50_000
THRESHOLD = 0.3
#: Keys with these crc32 remainders (modulo 4) are counted, and those calibrate.
COUNTED, CALIBRATED, HELD_OUT = (0, 1), (3,), 2
FEATURES = 7


def _tokens(block: A.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the words before them (0 at a text's start), and bounds."""
    words = A.words_of(block, A.PLAIN_SPACE)
    b = A.SpanHash(block.data, A.BYTE_KEYS_LOWER)(words.starts, words.ends)
    a = np.r_[np.zeros(1, np.uint64), b[:-1]][: len(b)]
    firsts = words.bounds[:-1]
    a[firsts[firsts < len(b)]] = 0
    return a, b, words.bounds


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ ((b << np.uint64(1)) | (b >> np.uint64(63)))


def _pair_column(a: str, b: str) -> Column:
    return F.col(a).bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63)))


def _counted(a: np.ndarray, b: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, ...]:
    return _merged([(a, b, ~toxic, toxic)])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Different pairs (a, b) and the sums of their counts in each class."""
    a, b, n0, n1 = (np.concatenate(x) for x in zip(*parts))
    _, at, which = np.unique(A.pair(a, b), return_index=True, return_inverse=True)
    return a[at], b[at], *(np.bincount(which, n, len(at)).astype(np.int64) for n in (n0, n1))


def _count_batches(counts: tuple[np.ndarray, ...]):
    a, b, n0, n1 = counts
    for i in range(0, len(a), 1 << 16):
        j = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([A.long_array(a[j]), A.long_array(b[j]), pa.array(n0[j]), pa.array(n1[j])], names=["a", "b", "n0", "n1"])


def count_pairs(train: DataFrame, text: str) -> DataFrame:
    """(a, b, n0, n1): pairs of neighbouring words (hashes) and their counts in each class."""
    A.ship(train.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            y = batch.column(1).to_numpy()
            for block in A.text_blocks(batch.column(0)):
                a, b, bounds = _tokens(block)
                held.append(_counted(a, b, np.repeat(y[block.first : block.last], np.diff(bounds)) == 1))
                size += len(held[-1][0])
                if size >= COUNT_ROWS:
                    merged = _merged(held)
                    # what hardly shrinks any more goes on
                    held, size = ([merged], len(merged[0])) if len(merged[0]) <= COUNT_ROWS // 2 else ([], 0)
                    if not held:
                        yield from _count_batches(merged)
        if held:
            yield from _count_batches(_merged(held))

    part = train.select(F.col(text).cast("string").alias("t"), "y").mapInArrow(run, "a long, b long, n0 long, n1 long")
    return part.groupBy("a", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(ones, twos) -> float:
    ones, twos = float(ones or 0), float(twos or 0)
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5


#: What the words table holds of a word w: p_c(w) and, as a context, its counts and different followers in each class and in both.
WORD_VALUES = ("p0", "p1", "s0", "s1", "s", "k0", "k1", "k")


@dataclass(frozen=True)
class Model:
    """words (key, *WORD_VALUES) and pairs (a, b, n0, n1), whole, and the discounts D of the classes and of both."""

    words: DataFrame | A.Pieces
    pairs: DataFrame | A.Pieces
    cuts: tuple[float, float, float]

    def pieces(self) -> Model:
        """The same as arrays that workers hold; the tables are deleted."""
        owner = uuid.uuid4().hex
        words = A.Pieces.of(owner, self.words, values=WORD_VALUES, spent=self.words)
        pairs = self.pairs.select(_pair_column("a", "b").alias("key"), "n0", "n1")
        return Model(words, A.Pieces.of(owner, pairs, values=("n0", "n1"), spent=self.pairs), self.cuts)


def learn(train: DataFrame, text: str) -> Model:
    pairs = A.table(count_pairs(train, text), "pairs")
    many = lambda c, k: F.sum((F.expr(c) == k).cast("long"))
    sides = {"0": "n0", "1": "n1", "": "n0 + n1"}
    n = pairs.agg(*[many(e, k).alias(f"d{c}_{k}") for c, e in sides.items() for k in (1, 2)]).first()
    cuts = tuple(_discount(n[f"d{c}_1"], n[f"d{c}_2"]) for c in sides)
    word = A.table(pairs.groupBy("b").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"t{c}") for c in (0, 1)], F.count(F.lit(1)).alias("t")), "words")
    n = word.agg(*[many(f"t{c}", k).alias(f"t{c}{k}") for c in (0, 1) for k in (1, 2)], F.sum("t").alias("all"), *[F.sum(f"t{c}").alias(f"s{c}") for c in (0, 1)], *[F.sum((F.col(f"t{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]).first()
    u = [_discount(n[f"t{c}1"], n[f"t{c}2"]) for c in (0, 1)]
    own = [F.greatest(F.col(f"t{c}") - u[c], F.lit(0.0)) / max((n[f"s{c}"] or 0) - u[c] * (n[f"k{c}"] or 0), 1e-9) for c in (0, 1)]
    low = [((1 - SHARED) * own[c] + SHARED * F.col("t") / max(n["all"] or 0, 1)).alias(f"p{c}") for c in (0, 1)]
    context = pairs.groupBy("a").agg(*[F.sum(F.expr(x)).alias(f"s{c}") for c, x in sides.items()], *[F.count_if(F.expr(x) > 0).alias(f"k{c}") for c, x in sides.items()])
    both = word.select(F.col("b").alias("key"), *low).join(context.withColumnRenamed("a", "key"), "key", "full")
    words = both.select("key", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in WORD_VALUES])
    words = A.table(words, "words")
    A.drop(word)
    return Model(words, pairs, cuts)


def features(blocks: list[A.Block], model: Model) -> np.ndarray:
    """Mean log-ratio, mean excess and share of exceeding words by pairs, the same by words alone, log length of each text."""
    keys, pair_keys, all_bounds, out = [np.zeros(1, np.int64)], [], [], []
    for block in blocks:
        a, b, bounds = _tokens(block)
        keys.append(b.view(np.int64))
        pair_keys.append(_pair(a, b).view(np.int64))
        all_bounds.append(bounds)
    words, pairs = model.words.each(keys, 0), model.pairs.each(pair_keys, 0)
    del a, b, keys, pair_keys  # the keys go when they are looked up
    start = next(words)
    with np.errstate(divide="ignore", invalid="ignore"):
        for bounds, word, n in zip(all_bounds, words, pairs):
            # the word before is the context; a text begins in that of no word
            before = np.r_[start, word[:-1]][: len(word)]
            firsts = bounds[:-1]
            before[firsts[firsts < len(word)]] = start
            p, s, k = word[:, :2], before[:, 2:5], before[:, 5:]
            n = np.c_[n, n.sum(1)]
            own = np.where(s > 0, np.maximum(n - np.asarray(model.cuts), 0) / s, 0)
            left = np.where(s > 0, np.asarray(model.cuts) * k / s, 1)
            likely = [np.where(s[:, c] > 0, (1 - SHARED) * (own[:, c] + left[:, c] * p[:, c]) + SHARED * (own[:, 2] + left[:, 2] * p[:, c]), own[:, 2] + left[:, 2] * p[:, c]) for c in (0, 1)]
            size, known, found = np.maximum(np.diff(bounds), 1), p[:, 0] > 0, []
            for one, two in (likely, p.T):
                ratio = np.where(known, np.log(np.maximum(two, 1e-12)) - np.log(np.maximum(one, 1e-12)), 0.0).astype(np.float64)
                over = np.maximum(ratio - EXCESS, 0)
                found += [A.sum_by(x, bounds) / size for x in (ratio, over, (over > 0).astype(np.float64))]
            out.append(np.stack([*found, np.log1p(np.diff(bounds))], 1))
    return np.concatenate(out)


def _scored(docs: DataFrame, model: Model, weights, keep: list[str], text: str, raw: bool, group: int = GROUP_BYTES) -> DataFrame:
    """keep and the features (``raw``) or the score of every row; ``group`` bytes go through all pieces at a time."""
    if isinstance(model.pairs, DataFrame):
        model = model.pieces()
    many = model.words.many or model.pairs.many

    def start():
        def work(column):
            blocks = list(A.text_blocks(column))
            x = features(blocks, model) if many else np.concatenate([features([b], model) for b in blocks])
            if raw:
                return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))]
            return [pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))]

        return work

    return A.append_columns(docs, text, keep, [("features", "array<double>") if raw else ("score", "double")], start, group=group if many else 0)


def score(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``keep``, score, held_out and predicted of every row; the model is learnt from ``labels``."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    named = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
    with A.Scope():
        model = learn(A.labelled(src, named, "key", "label", COUNTED), "text")
        group = LARGE_GROUP_BYTES if model.pairs.count() > MODEL_ROWS else GROUP_BYTES
        model = model.pieces()
        some = A.labelled(src, named, "key", "label", CALIBRATED, CALIBRATION_ROWS)
        x, y = A.sample(_scored(some, model, None, ["key", "y"], "text", True, group), ["features"], FEATURES)
    weights = A.logistic(x, y)
    held = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == HELD_OUT
    keep = [c for c in keep if c.lower() not in ("held_out", "predicted")]
    out = _scored(docs, model, weights, list(dict.fromkeys([*keep, key])), text, False, group)
    return out.withColumns({"held_out": held, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
