import random

import pytest

from chronolith.llm import leaks

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tre", "su", "vel") for b in ("lan", "dor", "kes", "rim", "pon") for c in ("ta", "vis", "mur", "go")]


def item(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def filler(seed, n=60):
    r = random.Random(seed + 1000)
    return " ".join(r.choice(["valve", "plate", "made", "of", "steel", "holds", "ring", "wherein", "device"]) for _ in range(n))


def words(i, a, b):
    return item(i).split()[a:b]


CASES = {
    "whole": (lambda: filler(1) + " " + item(1) + " " + filler(2), True),
    "fifteen": (lambda: filler(1) + " " + " ".join(words(1, 5, 20)) + " " + filler(2), True),
    "nine": (lambda: filler(1) + " " + " ".join(words(1, 5, 14)) + " " + filler(2), False),
    "twelve": (lambda: " ".join(words(1, 0, 12)), False),
    "case and punctuation": (lambda: ",  ".join(w.upper() for w in words(1, 0, 20)), True),
    "markup": (lambda: " ".join(f"<b>{w}</b>" for w in words(1, 0, 20)), True),
    "line breaks": (lambda: "\n".join(w[:2] + "-\n" + w[2:] for w in words(1, 0, 24)), True),
    "altered": (lambda: " ".join(w if k % 9 else "xqzv" for k, w in enumerate(words(1, 1, 38), 1)), True),
    "inserted": (lambda: " ".join(w if k % 6 else f"({k}) {w}" for k, w in enumerate(words(1, 0, 30), 1)), True),
    "shuffled": (lambda: " ".join(random.Random(3).sample(words(1, 0, 40), 40)), False),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    make, want = CASES[name]
    items = leaks.Items([1, 2], [item(1), item(2)]).build()
    got = {(d, items.ids[i]) for d, i, n in leaks.found([filler(9), make()], items) if n >= leaks.WORDS}
    assert got == ({(1, 1)} if want else set())


def test_accents_in_either_form():
    t = "élève préfère forêt château théâtre rivière évêque fenêtre école étroit bibliothèque éloigné rêveur côtier âgé marché crêpe"
    import unicodedata

    items = leaks.Items([1], [t]).build()
    (hit,) = leaks.found([unicodedata.normalize("NFD", t)], items)
    assert hit[2] == 17


def test_filter_loses_nothing_that_aligns():
    """Against alignment of every pair without the filter."""
    r = random.Random(5)
    ids = list(range(12))
    items = leaks.Items(ids, [item(i) for i in ids]).build()
    texts = []
    for k in range(60):
        i, a, n = r.choice(ids), r.randint(0, 15), r.choice([8, 12, 15, 16, 20, 25])
        part = [w if r.random() > 0.08 else "other" for w in words(i, a, a + n)]
        texts.append(f"{filler(k, 30)} {' '.join(part)} {filler(k + 7, 30)}")
    got = {(d, i) for d, i, n in leaks.found(texts, items) if n >= leaks.WORDS}
    want = set()
    for d, t in enumerate(texts):
        code, first, _ = leaks.folded([t])
        doc = leaks.split_words(code, __import__("numpy").flatnonzero(first))
        want |= {(d, i) for i in range(12) if leaks.aligned(items.words[i], doc) >= leaks.WORDS}
    assert got == want and want


def test_in_blocks(spark, docs_frame, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    evals = spark.createDataFrame([(i, item(i)) for i in range(4)] + [(7, None), (8, ""), (9, "too short"), (2, item(2))], "item_id long, text string")
    texts = [None, "", "   ", item(0), filler(1) + item(2) + " " + item(3), filler(2), "z" * 100_000]
    df = docs_frame(texts)
    got = {tuple(r) for r in leaks.leaks(df.union(df.where("doc_id = 3")), evals).collect()}
    assert got == {(3, 0), (4, 3), (4, 2)} or got == {(3, 0), (4, 3)}
    assert leaks.leaks(df.where("false"), evals).count() == 0 and leaks.leaks(df, evals.where("false")).count() == 0


@pytest.mark.parametrize("n", [15, 18, 20])
def test_chance_matches_before_a_passage(n):
    part = item(7, n).split()
    text = ["la", "x1", "x2", "de", "x3", "x4", *part]
    assert leaks.aligned(text, ["la", "y1", "y2", "de", "y3", "y4", *part]) >= n


def test_alignment_against_all_chains():
    """Every (first word, words matched) of every cell, none dropped."""
    r = random.Random(6)
    for _ in range(300):
        a, b = (["".join(r.choice("abcdef")) for _ in range(r.randint(5, 40))] for _ in range(2))
        ends, want = {}, 0
        for i, w in enumerate(a):
            for j, x in enumerate(b):
                for je in [j] * (w == x) + [j + 1] * (w == "".join(b[j : j + 2]) and j + 1 < len(b)):
                    before = [p for di in (1, 2, 3) for dj in (1, 2, 3, 4) for p in ends.get((i - di, j - dj), ())]
                    ends.setdefault((i, je), set()).update({(i, 1)} | {(f, n + 1) for f, n in before})
                    want = max([want, *(i - f + 1 for f, n in ends[i, je] if n >= leaks.MATCHED * (i - f + 1))])
        assert leaks.aligned(a, b) == want
