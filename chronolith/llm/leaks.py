"""Passages of evaluation items inside a corpus: q-gram filter in diagonal bands, then banded alignment of words."""

from __future__ import annotations

import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.session import shared_dir, spread
from chronolith.sources.files import arrow_filesystem

#: Characters in a q-gram, of the text without anything but letters and digits.
Q = 8
#: Successive words of an item that make a leak.
WORDS = 15
#: Least share of an aligned passage's words that match as they are: of 15 words 2 may be altered, of 20 words 3.
MATCHED = 0.85
#: Words among WORDS that the filter lets be lost; each costs at most its length plus Q - 1 shared q-grams. One more than
#: the alignment does, as words put in between cost q-grams, too.
ALTERED = int(WORDS * (1 - MATCHED)) + 1
#: Width of a diagonal band, in characters; bands overlap by half.
BAND = 64
#: Characters of item text in one block. Items beyond it go into further blocks, each against all documents.
BLOCK_CHARS = 4_000_000
#: Cells of the table that tells quickly that a q-gram stands in no item.
SIEVE_BITS = 22

TAG = regex.compile(r"<[^<>]{1,200}>")
BREAK = regex.compile(r"(?<=\p{L})[-­‐]\s*\n\s*(?=\p{Ll})")
#: Digits that scanned letters are often read as.
LOOKS = {"0": "o", "1": "l"}
MULT = np.uint64(0x9E3779B97F4A7C15)


def fold_table() -> np.ndarray:
    """For each BMP character its folded letter or digit, 0 for a separator, 1 for a mark that vanishes."""
    out = np.zeros(65536, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalnum():
            base = unicodedata.normalize("NFKD", c)[0].lower()[0] if not 0xAC00 <= i < 0xD7A4 else c
            out[i] = ord(LOOKS.get(base, base)) & 0xFFFF
        elif unicodedata.category(c) in ("Mn", "Cf"):
            out[i] = 1
    return out


_table: np.ndarray | None = None


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts in one array: folded characters, whether one begins a word, and the index of its text."""
    global _table
    if _table is None:
        _table = fold_table()
    texts = [clean(t) for t in texts]
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = np.where(raw < 65536, _table[np.minimum(raw, 65535)], np.uint32(0))
    solid = code != 1
    code, at = code[solid], np.flatnonzero(solid)
    letter = np.flatnonzero(code > 1)
    before = np.where(letter > 0, code[np.maximum(letter, 1) - 1], 0)
    return code[letter], (before == 0) | (letter == 0), np.searchsorted(ends, at[letter], "right").astype(np.int32)


def clean(t: str) -> str:
    if "<" in t:
        t = TAG.sub(" ", t)
    if "-\n" in t or "­" in t or "‐" in t or "- \n" in t:
        t = BREAK.sub("", t)
    return t


def gram_hashes(code: np.ndarray) -> np.ndarray:
    """A hash of the Q = 8 characters from each position on, by doubling."""
    if len(code) < Q:
        return np.zeros(0, np.uint64)
    h = code.astype(np.uint64) * MULT
    for k in (1, 2, 4):
        h = (h[:-k] * np.uint64(0xD1B54A32D192ED03 + 2 * k)) ^ (h[k:] >> np.uint64(29)) ^ h[k:]
    return h ^ (h >> np.uint64(31))


@dataclass
class Items:
    """The q-grams of one block of items."""

    ids: list[int]
    texts: list[str]
    words: list[list[str]] = field(default_factory=list)
    word_at: list[np.ndarray] = field(default_factory=list)
    bound: np.ndarray = None
    grams: np.ndarray = None
    item: np.ndarray = None
    pos: np.ndarray = None
    sieve: np.ndarray = None

    def build(self) -> "Items":
        hs, its, ps, bounds = [], [], [], []
        for k, t in enumerate(self.texts):
            code, first, _ = folded([t])
            starts = np.flatnonzero(first)
            self.words.append(split_words(code, starts))
            self.word_at.append(starts)
            size = np.diff(np.r_[starts, len(code)])
            # the lemma: what any WORDS successive words share with a copy in which ALTERED words are altered
            if len(size) >= WORDS:
                windows = np.lib.stride_tricks.sliding_window_view(size, WORDS)
                lost = np.sort(windows, 1)[:, -ALTERED:].sum(1) + ALTERED * (Q - 1)
                bounds.append(max(1, int((windows.sum(1) - Q + 1 - lost).min())))
            else:
                bounds.append(1 << 30)
            h = gram_hashes(code)
            hs.append(h), its.append(np.full(len(h), k, np.int32)), ps.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        o = np.argsort(h, kind="stable")
        self.grams, self.bound = h[o], np.array(bounds, np.int64)
        self.item = (np.concatenate(its) if its else np.zeros(0, np.int32))[o]
        self.pos = (np.concatenate(ps) if ps else np.zeros(0, np.int32))[o]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.grams >> np.uint64(64 - SIEVE_BITS)] = True
        return self


def split_words(code: np.ndarray, starts: np.ndarray) -> list[str]:
    s = code.astype("<u4").tobytes().decode("utf-32-le", "replace")
    cuts = [*starts.tolist(), len(s)]
    return [s[a:b] for a, b in zip(cuts, cuts[1:])]


def aligned(item: list[str], doc: list[str]) -> int:
    """The largest number of successive words of ``item`` that stand in ``doc`` in order, words that match joined over at
    most one item word and two words of the document in between. A word of the item also matches two that it was
    broken into. At least MATCHED of the words must match. The search stays in the band that these joins span. Every start
    is followed that may still win: one is dropped only for an earlier one that has no fewer matches to spare."""
    where = defaultdict(list)
    for j, w in enumerate(doc):
        where[w].append((j, j))
        if j + 1 < len(doc):
            where[w + doc[j + 1]].append((j, j + 1))
    best, ends = 0, {}  # (i, j of the last word) -> [(first i, words matched)], by first i
    for i, w in enumerate(item):
        for j, je in where.get(w, ()):
            matched = dict(ends.get((i, je), ()))  # first i -> words matched
            matched.setdefault(i, 1)
            for di in (1, 2, 3):
                for dj in (1, 2, 3, 4):
                    for first, n in ends.get((i - di, j - dj), ()):
                        if n + 1 > matched.get(first, 0):
                            matched[first] = n + 1
            kept, most = [], 0.0
            for first, n in sorted(matched.items()):
                if n + MATCHED * first > most:
                    kept.append((first, n))
                    most = n + MATCHED * first
                    if i - first + 1 > best and n >= MATCHED * (i - first + 1):
                        best = i - first + 1
            ends[i, je] = kept
    return best


def found(texts: list[str], items: Items) -> list[tuple[int, int, int]]:
    """(index of text, index of item, words) of every pair whose aligned words reach 1."""
    code, first, doc = folded(texts)
    h = gram_hashes(code)
    hit = np.flatnonzero(items.sieve[h >> np.uint64(64 - SIEVE_BITS)]) if len(h) else np.zeros(0, np.int64)
    lo = np.searchsorted(items.grams, h[hit], "left")
    n = np.searchsorted(items.grams, h[hit], "right") - lo
    hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
    if not len(hit):
        return []
    dp = np.repeat(hit, n)
    at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    it, ip, dd = items.item[at].astype(np.int64), items.pos[at].astype(np.int64), doc[dp].astype(np.int64)
    diag = dp - ip + (1 << 20)
    regions: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
    for shift in (0, BAND // 2):
        key = (dd * len(items.ids) + it) << 32 | (diag + shift) // BAND
        o = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(key[o]) != 0])
        count = np.diff(np.r_[cuts, len(o)])
        # per band: distinct places in the item, lest a repeated phrase in the document counts twice
        for c, k in zip(cuts[count >= items.bound[it[o[cuts]]]], count[count >= items.bound[it[o[cuts]]]]):
            rows = o[c : c + k]
            if len(np.unique(ip[rows])) >= items.bound[it[rows[0]]]:
                regions[int(dd[rows[0]]), int(it[rows[0]])].append((int(dp[rows].min()), int(dp[rows].max()), int(ip[rows].min()), int(ip[rows].max())))
    out = []
    for (d, i), parts in regions.items():
        best = 0
        parts.sort()
        merged = [list(parts[0])]
        for p in parts[1:]:  # regions that nearly touch are one
            m = merged[-1]
            if p[0] <= m[1] + 4 * BAND:
                m[1], m[2], m[3] = max(m[1], p[1]), min(m[2], p[2]), max(m[3], p[3])
            else:
                merged.append(list(p))
        for d0, d1, i0, i1 in merged:
            # the region may begin and end within a band of the shared q-grams
            a, b = max(0, d0 - 2 * BAND), min(len(code), d1 + Q + 2 * BAND)
            same = doc[a:b] == d
            a, b = a + int(same.argmax()), a + int(len(same) - same[::-1].argmax())
            starts = np.flatnonzero(first[a:b])
            if not len(starts):
                continue
            wa = items.word_at[i]
            w0 = max(0, int(np.searchsorted(wa, i0 - BAND, "right")) - 1)
            w1 = int(np.searchsorted(wa, i1 + Q + BAND, "left"))
            starts = starts if starts[0] == 0 else np.r_[0, starts]
            best = max(best, aligned(items.words[i][w0:w1], split_words(code[a:b], starts)))
        out.append((d, i, best))
    return out


def leaks(docs: DataFrame, evals: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id): every document that contains at least ``words`` successive words of an item, in any case,
    punctuation, spacing, line breaks, markup or accents' form, with single words altered or put in between.

    Texts are reduced to folded letters and digits. A document's q-grams are looked up among those of the items; for each
    item they are counted in overlapping diagonal bands, and only regions that reach what the q-gram lemma leaves at
    least are aligned, word by word. Documents are scanned where they are read, once for each block of items of at most
    BLOCK_CHARS characters; nothing is shuffled but the found pairs. Null and empty texts and items of fewer words than
    ``words`` give no rows; rows that repeat an id give each pair once.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(evals.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    got = evals.select("item_id", "text").where("text is not null and item_id is not null")
    size = got.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    # items go to the workers as files, not over the driver
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    got.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    texts = spread(docs.select("doc_id", "text").where("text is not null"))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = index(f"{path}/block={block}")
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = []
                for at in range(0, len(ids), 256):
                    rows += [(ids[at + d], items.ids[i]) for d, i, n in found([t or "" for t in texts[at : at + 256]], items) if n >= words]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], KINDS[kinds[1]])], names=["doc_id", "item_id"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out.distinct()


_index: dict[str, Items] = {}


def index(path: str) -> Items:
    """The q-grams of a block of items, kept for the worker's next task."""
    if path not in _index:
        fs, folder = arrow_filesystem(path)
        try:
            t = dataset.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
            rows = sorted(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))
        except FileNotFoundError:  # no item's hash falls here
            rows = []
        _index.clear()
        _index[path] = Items([i for i, _ in rows], [x for _, x in rows]).build()
    return _index[path]


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
