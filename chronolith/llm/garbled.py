"""Text that was decoded with another encoding than its own: found and, where possible, restored."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import spread, written

#: Only pairs in more than FLOOR of the documents are sent to the workers: at most the mean number of a document's distinct
#: pairs, divided by FLOOR, whatever the corpus. Others count as standing in half of it.
FLOOR = 0.0005
#: Background that is added to each character's share of documents: without it, what occurs nowhere but in garbled
#: sequences would have the highest information of all.
BACKGROUND = 0.1
#: Information below which a pair is improbable: it stands in a tenth of the documents that chance would put it in.
IMPROBABLE = math.log(0.1)
#: What a pair of ASCII characters takes from a run that reaches over it.
PLAIN = 1.0
#: Gain in nats that a restored passage needs, and that all of a text's passages of one mapping need together where the
#: bytes' form proves nothing.
GAIN = 2.0
GAIN_TEXT = 12.0
#: A restored word of at least so many letters is believed alone if it stands in more than FLOOR of the documents and in so
#: many times as many as the garbled one. Keys from WORD on stand for words among the pairs.
LETTERS = 4
WORD_TIMES = 10
WORD = 1 << 62
#: Keys from CHAR on stand for single characters.
CHAR = 1 << 61
#: Encodings of one byte a character in which texts are wrongly read or were written.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_15", "iso8859_5", "mac_cyrillic")
WRITTEN = ("cp1252", "cp1251", "koi8_r", "cp866", "cp850")
WRITTEN_WIDE = ("cp932", "euc_jp")
READ_WIDE = ("cp932", "euc_jp", "gb18030", "cp949", "big5")
#: Encodings under which a first character of UTF-8 that is always followed by a further one proves the reading wrong, and
#: how often and in what share of its places (but before white space) it must be.
FORM = ("cp1252", "iso8859_15", "cp1250", "cp437")
FORM_LEAST, FORM_SHARE = 4, 0.9

UTF8 = regex.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
CONTROL = regex.compile("[\x80-\x84\x86-\x9f]")


def symbols(code: np.ndarray) -> np.ndarray:
    """Characters of alphabets and signs as they are; others, as ideographs, by blocks of 256."""
    own = (code < 0x600) | ((code >= 0x1E00) & (code < 0x2C00)) | ((code >= 0x3000) & (code < 0x3100)) | ((code >= 0xFF00) & (code < 0x10000))
    return np.where(own, code, 0x110000 + (code >> 8)).astype(np.int64)


def pair_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, place) of adjacent characters of which one at least isn't ASCII; white space is a space."""
    code = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = code >= 128
    at = np.flatnonzero(wide[:-1] | wide[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = at[~np.isin(at, ends - 1)]  # not from the end of one text to the next
    owner = np.searchsorted(ends, at, "right")
    a, b = symbols(code[at]), symbols(code[at + 1])
    a, b = np.where(a < 33, 32, a), np.where(b < 33, 32, b)
    return owner, a << 24 | b, at - np.r_[0, ends][owner]


def document_frequencies(docs: DataFrame) -> tuple[dict[int, float], int]:
    """Share of all documents that hold each pair, and each word with a letter that isn't ASCII, for those above FLOOR, and
    each character, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = defaultdict(int)
        words: Counter[str] = Counter()
        n = 0

        def distinct(owner: np.ndarray, key: np.ndarray, mark: int) -> None:
            once = np.unique(owner.astype(np.int64) << 48 | key)  # owners are fewer than 2^8, keys below 2^46
            for x, y in zip(*(a.tolist() for a in np.unique(once & ((1 << 48) - 1), return_counts=True))):
                held[mark | x] += y

        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [t for t in b.column(0).slice(at, 256).to_pylist() if t]
                n += len(texts)
                if not texts:
                    continue
                for t in texts:
                    words.update(own_words(t))
                owner, pair, _ = pair_codes(texts)
                distinct(owner, pair, 0)
                # characters: ASCII ones of all texts, others stand first or second in one of the pairs
                code = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                of = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in texts]))[: len(code)]
                plain = np.bincount((of << 7 | code)[code < 128], minlength=len(texts) << 7).reshape(-1, 128) > 0
                plain[:, 32] |= plain[:, 1:32].any(1)
                for c, y in enumerate(plain.sum(0).tolist()):
                    if y and c >= 32:
                        held[CHAR | c] += y
                both, every = np.r_[owner, owner], np.r_[pair >> 24, pair & 0xFFFFFF]
                wide = every >= 128
                distinct(both[wide], every[wide], CHAR)
        for w, c in words.items():
            held[word_key(w)] += c
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held], pa.int64()), pa.array([n, *held.values()], pa.int64())], names=["pair", "df"])

    # one row for each pair and task, then one for each pair
    got = docs.select("text").where("text is not null").mapInArrow(count, "pair long, df long").groupBy("pair").agg(F.sum("df").alias("df"))
    got = written(got, "pairs")
    n = (got.where("pair = -1").agg(F.sum("df")).first()[0]) or 0
    # characters are symbols, of which there are a few thousand
    kept = got.where((F.col("pair") >= 0) & ((F.col("df") > F.lit(FLOOR * n)) | F.col("pair").between(CHAR, WORD - 1)))
    return {r["pair"]: r["df"] / n for r in kept.toLocalIterator()}, n


class Model:
    """Scores of adjacent characters from the corpus.

    A pair's score is its pointwise mutual information over documents: the logarithm of the share of documents that hold it,
    over the product of its characters' shares, to each of which BACKGROUND is added. Pairs that may be parts of UTF-8 read as
    another encoding, and those with U+FFFD or control characters, may owe all their occurrences to wrong decoding: they count
    as unseen. Pairs of ASCII characters say nothing and score 0.
    """

    def __init__(self, shares: dict[int, float]):
        self.words = {p: x for p, x in shares.items() if p >= WORD}
        self.least = math.log(FLOOR / 2)
        chars = {p - CHAR: x for p, x in shares.items() if CHAR <= p < WORD}
        self.base = defaultdict(lambda: math.log(BACKGROUND), {c: math.log(x + BACKGROUND) for c, x in chars.items()})
        shares = {p: x for p, x in shares.items() if p < CHAR}
        self.seen: dict[tuple[str, str, str], tuple] = {}
        self.alone: dict[tuple, tuple[str, str] | None] = {}
        self.bytes_of = {w: single_byte(w) for w in READ_AS}
        self.leads = {w: {c for c, b in t.items() if 0xC2 <= b < 0xF5} for w, t in self.bytes_of.items()}
        self.chars = {w: {c for c in t if ord(c) > 127} for w, t in self.bytes_of.items()}
        self.maps = {(w, r): turned(t, r) for w, t in self.bytes_of.items() for r in WRITTEN if r != w}
        self.known: dict[int, int] = {}
        self.as_bytes = {w: ByteText({ord(c): b for c, b in self.bytes_of[w].items()}) for w in FORM}
        formed = {ord(a) << 24 | ord(b) for t in self.bytes_of.values() for a, x in t.items() if 0xC2 <= x < 0xF5 for b, y in t.items() if 0x80 <= y < 0xC0 and writable(x, y) and not ordinary(a, b)}
        self.score = {p: math.log(x) for p, x in shares.items() if p not in formed and not lost(p)}
        known = sorted(self.score)
        self.pair_at = np.array(known, np.int64)
        self.pair_score = np.array([self.score[p] for p in known])
        self.base_at = np.full(0x110000 + 0x1100, math.log(BACKGROUND))
        for c, x in self.base.items():
            self.base_at[c] = x

    def pairs(self, s: str) -> list[float]:
        get, least, sym, base = self.score.get, self.least, self.symbol, self.base
        codes = [sym(ord(c)) for c in s]
        return [0.0 if a < 128 and b < 128 else get(a << 24 | b, least) - base[a] - base[b] for a, b in zip(codes, codes[1:])]

    def unknown(self, s: str) -> bool:
        """No pair of it stands anywhere, as far as it isn't ASCII."""
        codes = [self.symbol(ord(c)) for c in s]
        return not any(a << 24 | b in self.score for a, b in zip(codes, codes[1:]) if a > 127 or b > 127)

    def symbol(self, c: int) -> int:
        if c < 128:
            return c if c > 32 else 32
        if c not in self.known:
            self.known[c] = int(symbols(np.array([c]))[0])
        return self.known[c]

    def total(self, s: str) -> float:
        return sum(self.pairs(s))

    def runs(self, texts: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Maximal scoring runs of improbable pairs by text, as ranges of characters. A pair scores what its information falls
        short of IMPROBABLE, so only improbable ones add to a run; what lies between takes from it. Found by the stack of
        left-minimal runs over the improbable pairs, with running totals of all."""
        owner, pair, at = pair_codes(texts)
        if not len(pair):
            return {}
        k = np.minimum(np.searchsorted(self.pair_at, pair), max(0, len(self.pair_at) - 1))
        seen = self.pair_at[k] == pair if len(self.pair_at) else np.zeros(len(pair), bool)
        share = np.where(seen, self.pair_score[k], self.least) if len(self.pair_at) else np.full(len(pair), self.least)
        gain = IMPROBABLE - (share - self.base_at[pair >> 24] - self.base_at[pair & 0xFFFFFF])
        gap = np.r_[0, np.where(owner[1:] == owner[:-1], at[1:] - at[:-1] - 1, 0) * PLAIN]
        total = np.cumsum(gain - gap)
        odd = np.flatnonzero(gain > 0)
        out: dict[int, list[tuple[int, int]]] = {}
        stack: list[tuple[int, int, float, float]] = []  # from, to (pairs), total before, total after
        text = -1
        for o, p, before, after in zip(owner[odd].tolist(), at[odd].tolist(), (total[odd] - gain[odd]).tolist(), total[odd].tolist()):
            if o != text:
                text, stack = o, []
                out[o] = stack
            run = (p, p, before, after)
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= run[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= run[3]:
                    break
                run = (stack[j][0], p, stack[j][2], run[3])
                del stack[j:]
            stack.append(run)
        return {o: [(a, min(b + 2, len(texts[o]))) for a, b, _, _ in runs] for o, runs in out.items()}

    def restore(self, s: str, left: str, right: str) -> tuple[str, str | None, float, bool]:
        """(text, mapping, gain, proven) of a piece of a run between these characters, by the best inverse mapping."""
        key = (s, left, right)
        if (x := self.seen.get(key)) is None:
            x = self.restored(s, left, right)
            if len(self.seen) > 300_000:
                self.seen.clear()
            if len(s) < 200:
                self.seen[key] = x
        return x

    def restored(self, s: str, left: str, right: str) -> tuple[str, str | None, float, bool]:
        old, mine = self.total(left + s + right), {c for c in s if ord(c) > 127}
        best = (s, None, 0.0, False)
        for name, table in self.bytes_of.items():
            if not mine & self.leads[name]:
                continue
            new, changed = self.as_utf8(s, left, right, table)
            if changed:
                gain = self.total(left + new + right) - old
                if gain > max(best[2], GAIN if changed < 3 else 0):
                    best = (new, f"{name}>utf-8", gain, True)
        if mine and max(mine) > "\u2e80" and len(s) > 1:
            for name in READ_WIDE:
                try:
                    new = s.encode(name).decode("utf-8")
                except UnicodeError:
                    continue
                gain = self.total(left + new + right) - old
                if gain > max(best[2], GAIN):
                    best = (new, f"{name}>utf-8", gain, True)
        if mine <= self.chars["cp1252"] and len(mine) > 1:
            data = bytes(self.bytes_of["cp1252"].get(c, 0x3F) for c in s)
            for to in WRITTEN_WIDE:
                try:
                    new = data.decode(to)
                except UnicodeError:
                    continue
                if len(new) < len(s) and not CONTROL.search(new):
                    gain = self.total(left + new + right) - old
                    if gain > max(best[2], GAIN):
                        best = (new, f"cp1252>{to}", gain, False)
        if best[3]:
            return best
        for name in READ_AS:
            if not mine <= self.chars[name]:
                continue
            for to in WRITTEN:
                turn = self.maps.get((name, to))
                if turn is None or not mine <= turn[1]:
                    continue
                new = s.translate(turn[0])
                if not in_words(left, s, new, right):
                    continue
                gain = self.total(left + new + right) - old
                if gain > max(best[2], GAIN):
                    best = (new, f"{name}>{to}", gain, False)
        return best

    def as_utf8(self, s: str, left: str, right: str, table: dict[str, int]) -> tuple[str, int]:
        out, at, changed = [], 0, 0
        data = bytes(table.get(c, 0x20) if ord(c) > 127 else 0x20 for c in s)
        for m in UTF8.finditer(data):
            new = m.group().decode("utf-8")
            layered = UTF8.fullmatch(bytes(table.get(c, 0x20) for c in new))  # garbled twice: the next round goes on
            if not layered and (CONTROL.search(new) or self.unknown((s[m.start() - 1] if m.start() else left) + new + (s[m.end()] if m.end() < len(s) else right))):
                continue  # no pair of it stands anywhere else: valid by chance
            out += [s[at : m.start()], new]
            at, changed = m.end(), changed + m.end() - m.start()
        return "".join([*out, s[at:]]), changed

    def known_word(self, t: str, a: int, b: int, new: str) -> bool:
        """Whether all that differs in the restored piece lies in words that are frequent only as restored."""
        if not self.words or len(new) != b - a:
            return False
        m, stop = token_start(t, a), TOKEN_END.search(t, b)
        end = stop.start() if stop else len(t)
        old, new = t[m:end], t[m:a] + new + t[b:end]
        spans = [x.span() for x in OWN.finditer(new) if new[x.start() : x.end()] != old[x.start() : x.end()]]
        share = lambda w: self.words.get(word_key(w), 0.0)
        if not all(share(new[x:y]) > WORD_TIMES * share(old[x:y]) for x, y in spans):
            return False
        return bool(spans) and all(x == y or any(i <= k < j for i, j in spans) for k, (x, y) in enumerate(zip(old, new)))

    def lone(self, t: str, a: int, b: int, left: str, right: str) -> tuple[str, str] | None:
        """(text, mapping) of a piece that no mapping makes more probable, where one makes it part of a known word."""
        m, stop = token_start(t, a), TOKEN_END.search(t, b)
        key = (t[m : stop.start() if stop else len(t)], a - m, b - m)
        if key not in self.alone:
            if len(self.alone) > 100_000:
                self.alone.clear()
            mine = {c for c in t[a:b] if ord(c) > 127}
            options = ((t[a:b].translate(turn), f"{name}>{to}") for (name, to), (turn, chars) in self.maps.items() if mine <= chars)
            self.alone[key] = next((x for x in options if in_words(left, t[a:b], x[0], right) and self.known_word(t, a, b, x[0])), None)
        return self.alone[key]

    def by_form(self, t: str, runs: list[tuple[int, int]]) -> tuple[str, str, int]:
        """(text, mapping, passages) with UTF-8 put right inside runs that its form alone proves: see FORM. Scores don't count
        here, as all texts of a language may be garbled alike."""
        if sum(len(MAYBE.findall(t, a, b)) for a, b in runs) < FORM_LEAST:
            return t, "", 0
        inside = np.zeros(len(t) + 1, bool)
        for a, b in runs:
            inside[a:b] = True
        for name in FORM:
            data = t.translate(self.as_bytes[name]).encode("latin-1")
            found = [(*m.span(), m.group().decode("utf-8")) for m in UTF8.finditer(data) if inside[m.start() : m.end()].all()]
            held = Counter(c.encode()[0] for _, _, new in found for c in new)
            places = Counter(x[0] for x in LEAD.findall(data)) if held and max(held.values()) >= FORM_LEAST else {}
            sure = {b for b, n in held.items() if n >= max(FORM_LEAST, FORM_SHARE * places.get(b, math.inf))}
            out, at, n = [], 0, 0
            for a, b, new in found if sure else ():
                if all(c.encode()[0] in sure and WRITING.match(c) for c in new):
                    out += [t[at:a], new]
                    at, n = b, n + 1
            if n >= FORM_LEAST:
                return "".join([*out, t[at:]]), f"{name}>utf-8", n
        return t, "", 0

    def pieces(self, t: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs, with what is next to them and isn't ASCII, as it may belong to them, cut at white space."""
        out: list[tuple[int, int]] = []
        end = 0
        for a, b in sorted(runs):
            a = max(a, end)
            while a > end and ord(t[a - 1]) > 127 and t[a - 1] not in EDGES:
                a -= 1
            while b < len(t) and ord(t[b]) > 127 and t[b] not in EDGES:
                b += 1
            if a < b:
                out += [(a + m.start(), a + m.end()) for m in PIECE.finditer(t[a:b]) if not m.group().isascii()]
                end = b
        return out

    def text(self, t: str, runs: list[tuple[int, int]]) -> tuple[bool, str, str]:
        """(affected, restored text, mapping). Mappings that the bytes' form doesn't prove need GAIN_TEXT in all. Goes on as
        long as a round explains something, as text can be garbled more than once; each makes it shorter or more probable."""
        used: dict[str, float] = defaultdict(float)
        lost_too, before = False, set()
        while t not in before:
            before.add(t)
            found, gains, rest, at_once = [], defaultdict(float), [], self.pieces(t, runs)
            for a, b in at_once:
                left, right = t[a - 1] if a else " ", t[b] if b < len(t) else " "
                lost_too = lost_too or "\ufffd" in t[a:b]
                new, name, gain, proven = self.restore(t[a:b], left, right)
                rest.append((a, b, left, right, new if proven else t[a:b]))
                if name:
                    found.append((a, b, new, name, proven))
                    gains[name] += gain
                elif x := self.lone(t, a, b, left, right):
                    found.append((a, b, *x, False))
            best = max(gains, key=gains.get, default=None)
            turn = self.maps.get(tuple(best.split(">"))) if best and gains[best] >= GAIN_TEXT else None
            own: dict[int, tuple] = {}
            for a, b, left, right, other in rest if turn else ():  # what the text's mapping improves in its runs, single letters too
                s, new = t[a:b], t[a:b].translate(turn[0])
                if new != s and not any(x.isspace() for x in s) and self.total(left + new + right) > self.total(left + other + right):
                    own[a] = (a, b, new, best, False)
            if turn:
                found = [*own.values(), *(x for x in found if x[4] and x[0] not in own)]
            out, at = [], 0
            for a, b, new, name, proven in sorted(found):
                if proven or (name == best and gains[name] >= GAIN_TEXT) or self.known_word(t, a, b, new):
                    out += [t[at:a], new]
                    at = b
                    used[name] += 1
            t = "".join([*out, t[at:]])
            if not out:  # nothing scores any more
                t, name, n = self.by_form(t, runs)
                if not n:
                    break
                used[name] += n
            runs = self.runs([t]).get(0, [])
        affected = bool(used) or lost_too or any(CONTROL.search(t, a, b) for a, b in self.pieces(t, runs))
        return affected, t, max(used, key=used.get) if used else ""


#: Words of alphabets.
OWN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u052f]{%d,}" % LETTERS)


def own_words(t: str) -> set[str]:
    """Words with a letter that isn't ASCII."""
    return set() if t.isascii() else {w for w in set(OWN.findall(t)) if not w.isascii()}


def word_key(w: str) -> int:
    return WORD | int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 3


class ByteText(dict):
    """For str.translate: what isn't in the table becomes a question mark."""

    def __missing__(self, c: int) -> int:
        return 0x3F


def lost(pair: int) -> bool:
    return any(x == 0xFFFD or 0x80 <= x < 0xA0 and x != 0x85 for x in (pair >> 24, pair & 0xFFFFFF))


def writable(x: int, y: int) -> bool:
    """Whether UTF-8 of these first two bytes can be a character of WRITING."""
    return x >= 0xE0 or bool(WRITING.match(bytes([x, y]).decode("utf-8")))


def ordinary(a: str, b: str) -> bool:
    """Cyrillic letters as words have them: they form UTF-8 by chance."""
    return "\u0400" <= min(a, b) and max(a, b) < "\u0500" and not (a.islower() and b.isupper())


#: First bytes of UTF-8 but before white space, and alphabets and signs that texts are written in.
LEAD = regex.compile(rb"[\xc2-\xf4](?![ \t\r\n]|$)")
WRITING = regex.compile("[\u00a0-\u017f\u0370-\u045f\u2010-\u27ff\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uffef]")
EDGES = " \n\r\t"
TOKEN_END = regex.compile(r"[ \n\r\t]")
PIECE = regex.compile(r"[^ \n\r\t]+")


def token_start(t: str, q: int) -> int:
    return max(t.rfind(e, 0, q) for e in EDGES) + 1


def turned(table: dict[str, int], to: str) -> tuple[dict[int, str], set[str]]:
    """What becomes of each character that isn't ASCII if its byte is read as ``to``; where that is a letter or sign."""
    out = {}
    for c, b in table.items():
        if ord(c) > 127 and b > 127:
            new = bytes([b]).decode(to, "replace")
            if new != "\ufffd" and not CONTROL.match(new):
                out[ord(c)] = new
    return out, {chr(c) for c in out}


def in_words(left: str, old: str, new: str, right: str) -> bool:
    """At least one changed character touches a letter or digit, no changed one was white space, no letter of another
    alphabet comes to stand beside a Latin one and none in lower case before one in upper case."""
    touches, around = False, left + new + right
    for k, (a, b) in enumerate(zip(old, new)):
        if a == b:
            continue
        if a.isspace():
            return False
        if b.islower() and around[k + 2].isupper():
            return False
        near = [x for x in (around[k], around[k + 2]) if x.isalnum()]
        if b.isalpha() and b > "\u024f" and any(x.isalpha() and x < "\u0250" for x in near):
            return False
        touches = touches or bool(near)
    return touches


def single_byte(name: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined are the control characters of that number."""
    out = {}
    for i in range(256):
        c = bytes([i]).decode(name, "replace")
        out[chr(i) if c == "�" else c] = i
    if name == "cp1252":  # readers mix it with latin-1
        for i in range(128, 160):
            out.setdefault(chr(i), i)
    return out


#: A first and a further byte of UTF-8 under one of FORM.
MAYBE = regex.compile("|".join("[{}][{}]".format(*(regex.escape("".join(c for c, b in single_byte(w).items() if x <= b < y), special_only=False) for x, y in ((0xC2, 0xF5), (0x80, 0xC0)))) for w in FORM))


_model: dict[str, Model] = {}


def model_of(corpus: str, shared) -> Model:
    """Kept for the worker's next task, with the words it has seen."""
    if corpus not in _model:
        _model.clear()
        _model[corpus] = Model(shared.value)
    return _model[corpus]


def garbled(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, mapping): the documents in whose text at least one character came out wrong because bytes were
    decoded with an encoding other than theirs. ``restored`` has the passages put right that an inverse mapping explains;
    what was lost (U+FFFD) stays. ``mapping`` names the wrong and the right encoding of most passages, '' if none.

    Two passes over the whole texts: one counts in how many documents each character and each pair of adjacent characters
    stands, one scores each text. Null, empty and plain ASCII texts give no row; repeated rows give a row each.
    """
    docs = spread(docs.select("doc_id", "text"))
    shares, _ = document_frequencies(docs)
    shared, corpus = docs.sparkSession.sparkContext.broadcast(shares), uuid.uuid4().hex
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(corpus, shared)
        for b in batches:
            rows: list[tuple] = []
            for at in range(0, b.num_rows, 256):
                ids = b.column(0).slice(at, 256).to_pylist()
                texts = b.column(1).slice(at, 256).to_pylist()
                for k, runs in model.runs(texts).items():
                    hit, new, name = model.text(texts[k], runs)
                    if hit:
                        rows.append((ids[k], new, name))
            cols = [[r[k] for r in rows] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "restored", "mapping"])

    # texts of ASCII alone have as many bytes as characters, and no pair that is scored
    some = docs.where(F.octet_length("text") > F.length("text"))
    return some.mapInArrow(run, f"doc_id {kind}, restored string, mapping string")
