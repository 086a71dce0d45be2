import random

import pytest

WORDS = [a + b for a in "ka lo mi ne pu ra so ti vo xe".split() for b in "ba de fi gu ha jo".split()]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS[:12]))
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def edge(spark):
    """Texts with nulls, blanks, repeats, long words and odd characters; clashing and extra columns."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "one two", base[0], base[0], base[0].upper(), base[1] + "\n" + base[1], "a" * 3000, "Σίσυφος ΣΑΣ İ é 'tis we're 1234 x y z", "<|endoftext|> <|im_start|>", "line\nline\nline\n\nline", "#*$%&|<> " * 60, *base]
    for i in range(12):  # near copies of one long text
        words = base_long(rng).split() if i == 0 else list(long_)
        long_ = words if i == 0 else long_
        words = list(long_)
        if i:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = prose(rng, 90)
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(6)]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", len(t or ""), float(i), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string").repartition(3)


def base_long(rng: random.Random) -> str:
    return prose(rng, 220)


@pytest.fixture(scope="session")
def texts(edge):
    return {r["doc_id"]: r["text"] or "" for r in edge.collect()}
