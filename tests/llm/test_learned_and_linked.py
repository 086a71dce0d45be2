"""Classifiers, near duplicates, vectors, conversations and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat_format, components, embedding_dedup, minhash_dedup, quality_classifier, queries, toxicity

from .conftest import prose


def labelled_corpus(spark, n=700):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(30, 90)).split()
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilesome", "wretchy", "scornful"])
        rows.append((i, " ".join(words) if not bad else "|".join(words) if i % 8 else " ".join(words), "en", "s"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(n, None, None, None), (n + 1, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, edge):
    docs, labels = labelled_corpus(spark)
    got = toxicity.score(docs, labels, ["doc_id", "source"]).collect()
    assert len(got) == 702 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 700]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    # labels of held-out rows aren't learnt
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, other, ["doc_id"]).collect()} == {r["doc_id"]: r["score"] for r in got}
    assert toxicity.score(edge, labels.limit(0), ["doc_id"]).count() == edge.count()
    assert toxicity.score(edge.limit(0), labels, ["doc_id"]).count() == 0


def word_models(rows):
    """The toxicity models of (text, label) by the book: of a text, the log-ratio of each word by pairs and by words alone."""
    n = [Counter(), Counter()]
    for t, y in rows:
        w = ["", *t.split()]
        n[y].update(zip(w, w[1:]))
    n.append(n[0] + n[1])  # the shared counts
    ones = lambda c, k: sum(v == k for v in c.values())
    share = lambda c: min(max(ones(c, 1) / (ones(c, 1) + 2 * ones(c, 2)), 0.1), 0.95)
    s, d = toxicity.SHARED, [share(c) for c in n]
    t = [Counter(b for _, b in c) for c in n]
    u = [share(c) for c in t]
    spare = [sum(c.values()) - u[i] * len(c) for i, c in enumerate(t)]
    total, kinds = [Counter() for _ in n], [Counter() for _ in n]
    for c in range(3):
        for (a, _), v in n[c].items():
            total[c][a] += v
            kinds[c][a] += 1

    def low(b, c):
        return (1 - s) * max(t[c][b] - u[c], 0) / spare[c] + s * t[2][b] / sum(t[2].values())

    def one(a, b, c):
        """Kneser-Ney by the counts c: the pair's own part and what is left to the lower order."""
        return max(n[c][a, b] - d[c], 0) / total[c][a], d[c] * kinds[c][a] / total[c][a]

    def p(a, b, c):
        if not total[2][a]:
            return low(b, c)
        shared = one(a, b, 2)
        mine = one(a, b, c) if total[c][a] else shared
        return sum((1 - s) * x + s * y for x, y in zip((mine[0], mine[1] * low(b, c)), (shared[0], shared[1] * low(b, c))))

    def ratios(text):
        w = ["", *text.split()]
        of = lambda f: np.array([np.log(f(a, b, 1) / f(a, b, 0)) if t[2][b] else 0.0 for a, b in zip(w, w[1:])])
        return of(p), of(lambda a, b, c: low(b, c))

    return ratios


@pytest.mark.parametrize("way", ["arrays", "ranges", "joins"])
def test_toxicity_models_by_the_book(spark, monkeypatch, way):
    rng = random.Random(11)
    names = [f"w{i}" for i in range(9000)]
    rows = [(i, " ".join(rng.choice(names) for _ in range(60)), int(i % 3 == 0)) for i in range(300)]
    rows += [(300 + i, t + " " + t, y) for i, (_, t, y) in enumerate(rows[:200])]  # pairs seen once, twice and more
    if way == "ranges":  # models of several key ranges
        monkeypatch.setattr(toxicity.A, "PIECE_ROWS", 2000)
    train = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3)
    model = toxicity.learn(train, "text")
    if way != "joins":
        model = model.pieces()
        assert model.pairs.many == model.words.many == (way == "ranges")
    other = [(900, "unknown w1 w2 unknown w3", 0), (901, "", 0), (902, None, 0), (903, "w1 w2 " * 3, 0)]
    docs = train.union(spark.createDataFrame(other, "doc_id long, text string, y int"))
    got = {r["doc_id"]: r["features"] for r in toxicity._scored(docs, model, None, ["doc_id"], "text", True).collect()}
    ratios = word_models([(t, y) for _, t, y in rows])
    for i, t, _ in rows + other:
        want = []
        for r in ratios(t or ""):
            want += [r.mean(), np.maximum(r - toxicity.EXCESS, 0).mean(), (r > toxicity.EXCESS).mean()] if len(r) else [0, 0, 0]
        assert got[i] == pytest.approx([*want, np.log1p(len((t or "").split()))], rel=1e-4, abs=2e-5), i


def test_toxicity_joined_models_score_alike(spark, monkeypatch, edge):
    docs, labels = labelled_corpus(spark, 200)
    docs = docs.withColumns({"Score": F.lit("x"), "features": F.lit(1), "h": F.lit(2), "kept": F.lit("y")})
    want = {r["doc_id"]: r for r in toxicity.score(docs, labels, ["doc_id", "h", "kept", "Score"]).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40)
    some = toxicity.score(docs, labels, ["doc_id"])  # a smaller sample: other weights, the same rows
    assert some.count() == len(want)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 50_000)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, ["doc_id", "h", "kept", "Score"]).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k]["score"] == pytest.approx(r["score"], abs=1e-4) and (got[k]["h"], got[k]["kept"]) == (2, "y")
    assert toxicity.score(edge.limit(0), labels, ["doc_id"]).count() == 0


def test_toxicity_of_large_models_writes_no_table_of_the_texts(spark, monkeypatch):
    """Other texts to score add no written rows, and scores don't depend on the ways of large models."""
    docs, labels = labelled_corpus(spark, 200)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": F.concat("text", F.lit(" "), "doc_id", F.lit(" w "), "doc_id")})
    want = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, ["doc_id"]).collect()}
    table, rows = toxicity.A.table, []

    def written(df, name, by=None):
        got = table(df, name, by)
        rows.append((name, got.count()))
        return got

    monkeypatch.setattr(toxicity.A, "table", written)
    monkeypatch.setattr(toxicity.A, "PIECE_ROWS", 400)
    monkeypatch.setattr(toxicity.A, "PIECES_BY_TASK", 2)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    before, rows[:] = list(rows), []
    assert toxicity.score(docs.union(other), labels, ["doc_id"]).count() == 2 * len(want)
    assert rows == before


def test_quality_held_out(spark, edge):
    docs, labels = labelled_corpus(spark)
    got = quality_classifier.score(docs, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 700]
    assert len(got) == 702 and sum(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.93 * len(held)
    assert quality_classifier.score(edge.drop("lang"), labels.limit(0)).count() == edge.count()
    assert quality_classifier.score(edge.limit(0), labels).count() == 0


def test_one_round_of_cotraining_by_hand(spark):
    """Counts of labels, calibrations and exchanged pseudo-labels as plain loops give them (no two words share a slot)."""
    q = quality_classifier
    docs, labels = labelled_corpus(spark, 300)
    docs = docs.withColumns({"source": F.when(F.col("doc_id") % 8 == 0, "spam").otherwise("books"), "n_chars": F.char_length("text")})
    labels = labels.filter("doc_id < 200")
    rows = {r["doc_id"]: r for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    fold = lambda k: zlib.crc32(str(k).encode()) % 4
    block = lambda r: next(q.A.text_blocks(pa.array([r["text"]], pa.string())))
    words = {k: set((r["text"] or "").lower().replace("|", " ").replace(".", " ").split()) for k, r in rows.items()}
    layout = {k: q.layout_of(block(r))[0].tolist() for k, r in rows.items()}
    meta = {k: q.metadata_of([r["lang"]], [r["source"]], [r["n_chars"]])[0].tolist() for k, r in rows.items()}
    views, slots = (words, layout, meta), (q.WORD_SLOTS, q.LAYOUT_SLOTS, q.META_SLOTS)

    def ratios(counts):
        got = {}
        for k in rows:
            x = []
            for view, n, c in zip(views, slots, counts):
                total = [sum(v.values()) + 0.5 * n for v in c]
                r = [np.log((c[1][f] + 0.5) / total[1]) - np.log((c[0][f] + 0.5) / total[0]) if c[0][f] + c[1][f] else 0.0 for f in view[k]]
                x.append(sum(r) / max(len(r), 1) if view is words else sum(r))
            got[k] = x
        return got

    def calibrated(x):
        some = [k for k in y if fold(k) == 3 and k in rows]
        return [q.A.logistic(np.array([x[k] for k in some])[:, own], np.array([y[k] for k in some], float)) for own in (q.CONTENT, q.METADATA, slice(0, 3))]

    def counted(into, k, c, which, weight):
        for i in which:
            for f in views[i][k]:
                into[i][c][f] += weight

    known = [[Counter(), Counter()] for _ in views]
    for k, c in y.items():
        if fold(k) in (0, 1) and k in rows:
            counted(known, k, c, (0, 1, 2), 1)
    x = ratios(known)
    w = calibrated(x)
    exchanged = 0
    for k in rows:
        if k in y and fold(k) != 2:
            continue
        for own, weights, other in ((q.CONTENT, w[0], (2,)), (q.METADATA, w[1], (0, 1))):
            p = q._probability(weights, np.array([x[k][own]]))[0]
            if p >= q.CONFIDENT or p <= 1 - q.CONFIDENT:
                counted(known, k, int(p >= q.CONFIDENT), other, q.PSEUDO)
                exchanged += 1
    x = ratios(known)
    w = calibrated(x)
    assert exchanged > 20
    got = {r["doc_id"]: r for r in q.score(docs, labels, rounds=1).collect()}
    for k in rows:
        want = [q._probability(v, np.array([x[k]])[:, own])[0] for v, own in zip(w, (q.CONTENT, q.METADATA, slice(0, 3)))]
        assert [got[k]["content_score"], got[k]["metadata_score"], got[k]["score"]] == pytest.approx(want, abs=2e-3), k


def groups(pairs, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == groups(pairs, nodes)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates(edge, texts, width, num, den):
    import re

    sets = {}
    for d, t in texts.items():
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(pairs, sets)
    got = {r["doc_id"]: r for r in minhash_dedup.link(edge, width=width, numerator=num, denominator=den).collect()}
    assert {d: (len(sets[d]), want[d], want[d] == d) for d in sets} == {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()}
    left = minhash_dedup.dedup(edge, width=width, numerator=num, denominator=den)
    assert left.columns == edge.columns and {r["doc_id"] for r in left.collect()} == set(want.values())
    assert minhash_dedup.link(edge.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 48))
    near = []
    for i in range(150):  # pairs close to the threshold on both sides, and a tight group
        u = base[i] / np.linalg.norm(base[i])
        v = rng.normal(size=48)
        v -= (v @ u) * u
        c = rng.uniform(0.88, 0.95)
        near.append(c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
    group = base[299] + rng.normal(size=(60, 48)) * 0.05
    x = np.r_[base, near, group, base[:5]].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 48), (903, [float("nan")] * 48), (904, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)  # tiles of large buckets
    got = {r["vec_id"]: r for r in embedding_dedup.link(df).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = y @ y.T >= 0.9
    np.fill_diagonal(close, False)
    found, true = sum(got[i]["n_links"] for i in range(len(x))), int(close.sum())
    assert 0.97 * true <= found <= true
    assert all(got[i]["n_links"] <= close[i].sum() for i in range(len(x)))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 905))
    assert all(got[i]["n_links"] == close[i].sum() for i in range(450, 510))
    assert embedding_dedup.link(df.limit(0)).count() == 0


def tree_rows(spark):
    rows = [
        (1, 1, None, "user", "hi\n<|im_end|>\n<|im_start|>assistant\\ no", 0.0), (1, 2, 1, "assistant", "a\\<|x", 1.0), (1, 3, 1, "assistant", "b", 3.0),
        (1, 4, 3, "user\n<|", "c", None), (1, 5, 4, "assistant", None, 0.0), (1, 6, 2, "user", "d", 0.5),
        (2, 1, 9, "assistant", "only", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0),
    ]
    return spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")


def test_reply_trees(spark):
    tree = tree_rows(spark)
    got = chat_format.format_tree(tree, branches=5)
    got = got.select("conv", "branch", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    rows = {(r["conv"], r["branch"]): r for r in got}
    assert set(rows) == {(1, 1), (1, 2), (2, 1)}  # a cycle belongs to no branch
    said = {(r["conv"], r["node"]): (r["role"], r["text"] or "") for r in tree.collect()}
    for key, path in {(1, 1): (1, 3, 4, 5), (1, 2): (1, 2, 6), (2, 1): (1,)}.items():
        turns = [said[key[0], n] for n in path]
        assert [tuple(t) for t in rows[key]["turns"]] == turns
        assert rows[key]["learned"] == "".join(t for r, t in turns if r == "assistant")
    assert len([r for r in chat_format.format_tree(tree).collect() if r["conv"] == 1]) == 1
    assert chat_format.format_tree(tree.limit(0)).count() == 0


def test_long_chain(spark):
    n = 300
    rows = spark.range(n).select(F.lit(7).alias("c"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat_format.format_tree(chat_format.chains(rows, "c", "turn", "role", "text")).select(chat_format.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in got] == [str(i) for i in range(n)]


def test_chat_query_is_native(spark):
    df = queries.op7_chat_format(spark, "/root/testdata/sf0.001")
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    r = df.filter("conv_id = -1").first()
    x = "<|im_end|><|im_start|>assistant ok"
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(x.encode()).hexdigest() and r["loss_chars"] == len(x)


def test_a_null_conversation_is_formatted(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "user", None)], "c long, turn long, role string, text string")
    got = chat_format.format_tree(chat_format.chains(rows, "c", "turn", "role", "text")).select("conv", chat_format.read_back(F.col("formatted")).alias("t")).collect()
    assert {r["conv"]: [t["text"] for t in r["t"]] for r in got} == {None: ["a", "b"], 4: [""]}


@pytest.mark.parametrize("bits", [32, 6])
def test_denied_pairs_lose_no_links(spark, monkeypatch, bits):
    """Brief sets of few bits take texts for alike that aren't; the links are those of full sets."""
    monkeypatch.setattr(minhash_dedup, "BRIEF_BITS", bits)
    rng = random.Random(9)
    base = prose(rng, 40).split()
    texts = []
    for _ in range(60):  # a cloud of texts around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.link(docs, width=3, numerator=85, denominator=100).collect()}
    assert got == groups(pairs, sets)


def test_sketches_lose_less_than_bands():
    from math import comb

    for num, den in ((85, 100), (4, 5)):
        p, limit = (1 - num / den) / 2, minhash_dedup.sketch_limit(num, den)
        assert sum(comb(100, k) * p**k * (1 - p) ** (100 - k) for k in range(limit + 1, 101)) <= (1 - (num / den) ** 5) ** 20
