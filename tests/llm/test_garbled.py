import random

import pytest

from chronolith.llm import garbled

GERMAN = "Die Überzugsschicht ist für größere Behälter geeignet, während der Anschluß über einen Kühlkanal führt und dafür Wärme abführt".split()
FRENCH = "La pièce est fixée à l’unité réglée après contrôle, où la température dépasse une valeur mémorisée et le procédé s’arrête".split()
RUSSIAN = "Устройство содержащее корпус крышку и датчик температуры отличающееся тем что вал соединён с корпусом посредством втулки".split()


def text(words, seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    return [text(w, s) for w in (GERMAN, FRENCH, RUSSIAN) for s in range(120)]


def wrong(t, right, read):
    return t.encode(right).decode(read, "replace")


def latin(t):
    return t.replace("’", "'")


BAD = {
    "utf-8 as cp1252": lambda: wrong(latin(text(FRENCH, 900)).replace("à", "a"), "utf-8", "cp1252"),
    "utf-8 as latin-1": lambda: wrong(text(GERMAN, 901), "utf-8", "latin-1"),
    "utf-8 as cp437": lambda: wrong(text(GERMAN, 902), "utf-8", "cp437"),
    "utf-8 as mac": lambda: wrong(text(FRENCH, 903), "utf-8", "mac_roman"),
    "utf-8 twice": lambda: wrong(wrong(text(GERMAN, 904), "utf-8", "latin-1"), "utf-8", "latin-1"),
    "cp1251 as cp1252": lambda: wrong(text(RUSSIAN, 905), "cp1251", "cp1252"),
    "koi8 as cp1251": lambda: wrong(text(RUSSIAN, 906), "koi8_r", "cp1251"),
    "cp1252 as cp437": lambda: wrong(text(GERMAN, 907), "cp1252", "cp437"),
    "lost": lambda: wrong(text(GERMAN, 908), "cp1252", "utf-8"),
    "one word": lambda: text(GERMAN, 909) + " fÃ¼r " + text(GERMAN, 910),
}
GOOD = ["naïve café-style façade № 81", "FUNDAÇÃO SÃO LÁZARO", "Â and Ã denote the two operators, with â·ã < 32", "├── base ──┤ ║ 61 ║", "Ø 34 × ½″, ¼ turn, © mark", "für", "□ = (P□ □ P□)/□T", " ", "plain", "", None]


def test_found_and_restored(spark, docs_frame, corpus):
    bad = [f() for f in BAD.values()]
    df = docs_frame(corpus + bad + GOOD)
    got = {r["doc_id"]: (r["restored"], r["mapping"]) for r in garbled.garbled(df).collect()}
    n = len(corpus)
    assert set(got) == set(range(n, n + len(bad)))
    right = {"utf-8 as latin-1": text(GERMAN, 901), "utf-8 as cp437": text(GERMAN, 902), "utf-8 as mac": text(FRENCH, 903), "utf-8 twice": text(GERMAN, 904), "cp1251 as cp1252": text(RUSSIAN, 905), "koi8 as cp1251": text(RUSSIAN, 906), "one word": text(GERMAN, 909) + " für " + text(GERMAN, 910)}
    long = lambda t: [w for w in t.split(" ") if len(w) > 1]  # noqa: E731 - a single letter can be right in either reading
    for k, name in enumerate(BAD):
        if name in right:
            assert long(got[n + k][0]) == long(right[name]), name


def test_no_documents(spark, docs_frame):
    assert garbled.garbled(docs_frame(["x"]).where("false")).count() == 0
    assert garbled.garbled(docs_frame([None, "", "abc " * 50_000])).count() == 0


def test_runs_are_maximal():
    m = garbled.Model({})
    assert m.runs(["plain text", "abÃ¼cd", "", "ü" + "x" * 40 + "ü", "axüxxü"]) == {1: [(1, 5)], 3: [(0, 2), (40, 42)], 4: [(1, 6)]}
    assert m.runs([]) == {} and m.runs(["", "x"]) == {}


@pytest.mark.parametrize("kind", ["all of a language", "one sign", "lost", "controls"])
def test_a_third_garbled_alike(spark, docs_frame, kind):
    """A frequent garbling makes its own pairs common."""
    good = [text(w, s) + " 7 µm" * (s % 3 == 0) for w in (GERMAN, RUSSIAN) for s in range(100)]
    right = [latin(text(FRENCH, s)).replace("à", "a") if kind == "all of a language" else text("the ring holds a plate".split(), s) + " 12 µm." for s in range(100)]
    if kind in ("lost", "controls"):
        bad = [t.replace("µ", "�" if kind == "lost" else "\x85\x91") for t in right]
    else:
        bad = [wrong(t, "utf-8", "cp1252") for t in right]
    got = {r["doc_id"]: r["restored"] for r in garbled.garbled(docs_frame(good + bad)).collect()}
    assert set(got) == set(range(200, 300))
    if kind not in ("lost", "controls"):
        assert [got[200 + k] for k in range(100)] == right


@pytest.mark.parametrize("word,read", [("Behälter", "cp437"), ("Anschluß", "cp850"), ("réglée", "mac_roman"), ("größere", "cp437")])
def test_one_word_of_one_byte(spark, docs_frame, corpus, word, read):
    """A lone word that the corpus knows only as restored; one that it doesn't know stays."""
    bad = ["the ring holds a plate, " + wrong(word, "cp1252", read) + ", of steel", "the ring holds a plate, Mährkölb, of steel"]
    got = {r["doc_id"]: r["restored"] for r in garbled.garbled(docs_frame(corpus + bad)).collect()}
    assert got == {len(corpus): "the ring holds a plate, " + word + ", of steel"}
