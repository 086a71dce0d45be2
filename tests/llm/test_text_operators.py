"""Rules, tokens, packing, sharding and passages against brute force."""

import base64
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import byte_bpe, packing, quality_rules, sharding, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")

def empty(df):
    return df.limit(0)

def test_rules(edge, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(edge, ["doc_id", "kept"]).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        w, r = WORD.findall(t), got[d]
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert (r["log_perplexity"] is None) == (len(t.encode()) < quality_rules.ORDER)
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(edge), ["doc_id"]).count() == 0

def test_perplexity_is_a_distribution_and_bands_reject(spark, edge):
    model = quality_rules.fit(edge)
    grams, rest = model.dense()
    # in a context seen in training, all next bytes sum to one (no slots collide in so small a corpus)
    from tidemill.llm import arrays as A

    last = [b for b in range(256) if quality_rules._NORMAL[b] == b]
    data = np.frombuffer(b"".join(b"kaba" + bytes([b]) for b in last), np.uint8)
    block = A.Block(0, len(last), data, np.arange(len(last) + 1) * 5)
    p = np.exp(-quality_rules.log_perplexity(block, grams, rest, float(model.rest[0][1][0])))
    missing = (256 - len(last)) * float(model.rest[0][1][0]) / 256  # bytes that are folded onto others
    assert 0.97 - missing < float(p.sum()) < 1.01
    junk = "".join(chr(33 + (i * i * 7 + i // 3) % 90) + ("" if i % 6 else " ") for i in range(900))
    more = edge.select("doc_id", "text", "lang").union(spark.createDataFrame([(999, junk, "en")], "doc_id long, text string, lang string"))
    assert not quality_rules.judge(more, ["doc_id"]).filter("doc_id = 999").first()["kept"]

def byte_model(texts, order):
    """Interpolated modified Kneser-Ney over bytes, by the book: a function of n bytes to the last one's probability."""
    norm = [bytes(quality_rules._NORMAL[np.frombuffer(t.encode(), np.uint8)]) for t in texts]
    counts = {order: Counter(t[i : i + order] for t in norm for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts, total, freed = {}, {}, {}
    for n, level in counts.items():
        n1, n2, n3, n4 = (sum(c == k for c in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[n] = [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / max(n1, 1)), (2, 2 - 3 * y * n3 / max(n2, 1)), (3, 3 - 4 * y * n4 / max(n3, 1)))]
        total[n], freed[n] = Counter(), Counter()
        for g, c in level.items():
            total[n][g[:-1]] += c
            freed[n][g[:-1]] += cuts[n][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n, c = len(g), counts[len(g)].get(g, 0)
        if not total[n][g[:-1]]:
            return p(g[1:])
        return (c and c - cuts[n][min(c, 3) - 1]) / total[n][g[:-1]] + freed[n][g[:-1]] / total[n][g[:-1]] * p(g[1:])

    return norm, p

@pytest.mark.parametrize("piece_rows", [None, 3000])
def test_perplexity_is_that_of_full_keys(spark, monkeypatch, piece_rows):
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, 97 + rng.integers(0, 26, 600))) for _ in range(60)] + ["abc def" * 30, "abcd", ""]
    if piece_rows:  # a model of several key ranges
        monkeypatch.setattr(quality_rules.A, "PIECE_ROWS", piece_rows)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = quality_rules.fit(docs)
    got = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.score(docs, model, ["doc_id"]).collect()}
    norm, p = byte_model(texts, quality_rules.ORDER)
    mean = lambda t: -sum(np.log(p(t[i - 4 : i + 1])) for i in range(4, len(t))) / (len(t) - 4)
    for i, t in enumerate(norm):
        assert got[i] is None if len(t) < 5 else got[i] == pytest.approx(mean(t), rel=1e-6), i
    # n-grams that weren't counted back off; none answers for another
    other = ["".join(map(chr, 97 + rng.integers(0, 26, 400))), "ABC dEf\x00\xff zzzzz"]
    more = spark.createDataFrame([(i, t, "en") for i, t in enumerate(other)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.score(more, model, ["doc_id"]).collect()}
    for i, t in enumerate(other):
        t = bytes(quality_rules._NORMAL[np.frombuffer(t.encode(), np.uint8)])
        assert got[i] == pytest.approx(mean(t), rel=1e-6)

def test_byte_bpe_matches_the_library(edge, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(edge, path, ["doc_id", "source"], decode=True).collect()
    for r in got:
        assert list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]]), r["doc_id"]
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    assert byte_bpe.encode(empty(edge), path, ["doc_id"]).count() == 0

def test_byte_bpe_fold_as_a_column(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [" the", "été", "x", " international"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(byte_bpe.fold_column(F.col("w").cast("binary"), byte_bpe.rank_map(path)).alias("ids")).collect()
    assert [list(r["ids"]) for r in got] == [library.encode_ordinary(w) for w in words]

def test_packing_is_exact_and_tight(edge, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(edge, path, max_len=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], np.uint32).tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(empty(edge), path).count() == 0

def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        bounds = np.r_[0, np.cumsum(rng.integers(1, 30, rng.integers(1, 9)))].tolist()
        penalties = [0, *rng.integers(0, 9, len(bounds) - 1).tolist()]
        cuts = packing.choose_cuts(bounds, penalties, 64)

        def cost(cuts):
            total = 0
            for a, b in zip(cuts, cuts[1:]):
                n = bounds[b] - bounds[a]
                if n > 64:
                    return 1 << 30
                total += penalties[b] + (0 if n & (n - 1) == 0 and n >= 8 else 64 - n)
            return total

        inner = range(1, len(bounds) - 1)
        best = min(cost([0, *[i for k, i in enumerate(inner) if m >> k & 1], len(bounds) - 1]) for m in range(1 << len(inner)))
        assert cost(cuts) == best and cuts[0] == 0 and cuts[-1] == len(bounds) - 1

def test_differencing_is_tight_and_conserves():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 200)
    parts = np.zeros((200, 5), np.int64)
    parts[:, 0] = sizes
    total, place = sharding.difference(parts)
    assert [sizes[place[:, 0] == s].sum() for s in range(5)] == total.tolist()
    assert total.max() - total.min() <= 3
    small = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sorted(sharding.difference(small)[0].tolist()) == [14, 16]  # the textbook case
    assert all(sorted(p) == list(range(5)) for p in place)

def test_sharding(edge, texts, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)  # several levels
    rows = sharding.assign(edge, 4).collect()
    assert len(rows) == len(texts)
    by, group = defaultdict(list), {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode())
        by[r["shard"]].append(r)
        assert group.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    loads = [sum(r["size"] for r in s) for s in by.values()]
    groups = defaultdict(int)
    for r in rows:
        groups[texts[r["doc_id"]]] += r["size"]
    assert max(loads) - min(loads) <= max(groups.values())  # groups are indivisible
    assert sharding.assign(empty(edge), 4).count() == 0

def brute_passages(texts, length):
    raw = {d: t.encode() for d, t in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out[d] = gone
    return raw, out

@pytest.mark.parametrize(("length", "tree", "hot"), [(400, 32_768, 4096), (60, 32_768, 2), (120, 2, 4096), (120, 2, 3)])
def test_passages(edge, texts, length, tree, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TREE_CONTEXTS", tree)  # 2: by window hashes
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)  # 2, 3: common contexts and windows are spread
    raw, gone = brute_passages(texts, length)
    for r in suffix_dedup.cut(edge, ["doc_id", "kept"], length=length).collect():
        b, g = raw[r["doc_id"]], gone[r["doc_id"]]
        assert r["n_bytes"] == len(b) and r["n_removed"] == g.sum(), r["doc_id"]
        assert r["n_spans"] == int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else r["n_spans"] == 0
        assert bytes(r["kept"]) == bytes(np.frombuffer(b, np.uint8)[~g])
    assert suffix_dedup.cut(empty(edge), ["doc_id"]).count() == 0

def test_intervals_of_a_suffix_array():
    text = b"banana"
    suffixes = sorted(text[i:] for i in range(6))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [common(a, b) for a, b in zip(suffixes, suffixes[1:])]
    assert set(suffix_dedup.intervals(lcp)) == {(3, 1, 2), (1, 0, 2), (2, 4, 5)}

@pytest.mark.parametrize(("length", "tree"), [(60, 32_768), (120, 2)])
def test_repeats_have_all_their_occurrences(edge, texts, length, tree, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TREE_CONTEXTS", tree)
    raw, gone = brute_passages(texts, length)
    found, covered = defaultdict(set), {d: np.zeros(len(b), bool) for d, b in raw.items()}
    for r in suffix_dedup.groups(edge, length=length).collect():
        found[r["name"]].add((r["doc_id"], r["begin"], r["end"]))
        covered[r["doc_id"]][r["begin"] : r["end"]] = True
    assert found and all((covered[d] == gone[d]).all() for d in raw)
    for places in found.values():
        strings = {raw[d][a:b] for d, a, b in places}
        assert len(strings) == 1 and len(places) > 1 and len(s := strings.pop()) >= length
        assert places == {(d, m.start(), m.start() + len(s)) for d, b in raw.items() for m in re.finditer(b"(?=" + re.escape(s) + b")", b)}
    assert suffix_dedup.groups(empty(edge)).count() == 0
