"""Each stage of the pipeline, with its own parameters, against plain loops."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import arrays, quality_rules, toxicity

from .test_learned_and_linked import groups, word_models
from .test_text_operators import WORD, brute_passages, byte_model

SF = "/root/testdata/sf0.001"
#: Names that operators use for their results or within.
CLASHES = ("score", "predicted", "held_out", "kept", "n_words", "low", "high", "band_lang", "h", "g", "key", "k", "t", "n_bytes", "spans", "log_perplexity")


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet")
    return got.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def unchanged(left, docs, rows, but=()):
    """The rows that are left have their columns as they were."""
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    found = {r["doc_id"]: r for r in left.collect()}
    for k, r in found.items():
        assert all(r[c] == rows[k][c] for c in docs.columns if c not in but), k
    return found


def plain(t):
    """Words of letters, digits and all that isn't ASCII; A-Z lower-cased."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), " ".join(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t or "")))


def test_toxicity_stage(spark, docs, rows, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    texts = {k: plain(r["text"]) for k, r in rows.items()}
    ratios = word_models([(texts[k], y) for k, y in labels.items() if k in rows and fold(k) in (0, 1)])

    def features(t):
        out = []
        for r in ratios(t):
            out += [r.mean(), np.maximum(r - toxicity.EXCESS, 0).mean(), (r > toxicity.EXCESS).mean()] if len(r) else [0, 0, 0]
        return [*out, np.log1p(len(t.split()))]

    x = {k: features(t) for k, t in texts.items()}
    some = [k for k in labels if k in rows and fold(k) == 3]
    w = arrays.logistic(np.array([x[k] for k in some]), np.array([labels[k] for k in some], float))
    p = {k: 1 / (1 + np.exp(-np.clip(np.array(v) @ w[:-1] + w[-1], -30, 30))) for k, v in x.items()}
    left = unchanged(stages["toxicity"](spark, docs, SF), docs, rows)
    clear = {k for k, v in p.items() if abs(v - toxicity.THRESHOLD) > 0.01}  # arrays hold floats of 32 bits
    assert len(clear) > 0.95 * len(rows)
    assert set(left) & clear == {k for k in clear if p[k] < toxicity.THRESHOLD}


def test_quality_rules_stage(spark, docs, rows, stages):
    norm, p = byte_model([r["text"] or "" for r in rows.values()], quality_rules.ORDER)
    cache, passed, mean = {}, {}, {}
    for (k, r), t in zip(rows.items(), norm):
        w = WORD.findall(r["text"] or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        passed[k] = not (len(w) < 50 or 100 * len(again) > 50 * len(w))
        grams = [t[i - 4 : i + 1] for i in range(4, len(t))]
        for g in set(grams) - cache.keys():
            cache[g] = np.log(p(g))
        mean[k] = -sum(cache[g] for g in grams) / len(grams) if grams else None
    bands = {}
    for lang in {r["lang"] for r in rows.values()}:
        bins = sorted(int(np.floor(mean[k] * 1000)) for k, r in rows.items() if r["lang"] == lang and passed[k])
        if bins:
            q1, q3 = (bins[-(-len(bins) * i // 4) - 1] for i in (1, 3))
            spread = max(q3 - q1, 1) * quality_rules.SPAN
            bands[lang] = (q1 - spread) / 1000, (q3 + 1 + spread) / 1000
    want = {k for k, r in rows.items() if passed[k] and bands[r["lang"]][0] <= mean[k] <= bands[r["lang"]][1]}
    left = unchanged(stages["quality_rules"](spark, docs, SF), docs, rows)
    assert set(left) == want and 0 < len(want) < len(rows)


def test_minhash_dedup_stage(spark, docs, rows, stages):
    sets = {}
    for k, r in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    left = unchanged(stages["minhash_dedup"](spark, docs, SF), docs, rows)
    assert set(left) == set(groups(pairs, sets).values()) and len(left) < len(rows)


def test_suffix_dedup_stage(spark, docs, rows, stages):
    shared = " ".join(f"pässage{i}" for i in range(55))  # over 50 words, in characters of two bytes
    planted = spark.createDataFrame([(10_000 + i, f"{'abc' * i}{i} {shared} {i}{'xyz' * i}") for i in range(3)], "doc_id long, text string")
    more = docs.unionByName(planted, allowMissingColumns=True)
    every = {r["doc_id"]: r for r in more.collect()}
    raw, gone = brute_passages({k: r["text"] or "" for k, r in every.items()}, 200)
    left = unchanged(stages["suffix_dedup"](spark, more, SF), more, every, but=("text", "n_chars"))
    assert set(left) == set(every)
    removed = 0
    for k, r in left.items():
        want, at = [], 0
        for c in raw[k].decode():
            n = len(c.encode())
            if not gone[k][at : at + n].all():
                want.append(c)
            at += n
        assert r["text"] == "".join(want) and r["n_chars"] == len(want), k
        removed += r["text"] != every[k]["text"]
    assert removed >= 3 and all(shared[20:-20] not in left[10_000 + i]["text"] for i in range(3))


def test_packing_stage(spark, docs, rows, stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stages["packing"](spark, docs, SF).collect()
    pieces, filled = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    for k, row in rows.items():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled.values())
    assert max(filled.values()) <= 2048 and padding < 0.04 * sum(filled.values())


def test_empty_tables_pass(spark, docs, stages):
    none = docs.limit(0)
    for name, stage in stages.items():
        left = stage(spark, none, SF)
        assert left.count() == 0 and (name == "packing" or left.columns == docs.columns), name
