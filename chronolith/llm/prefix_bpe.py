"""Byte-pair encoding by dynamic programming over byte prefixes.

Of every prefix of a piece only the last token of its encoding is kept. It is unique: token t may end the prefix of
length e exactly if the pair (last token of the prefix before t, t) is itself a valid encoding, that is, if encoding the
two tokens' bytes gives back the two. Following last tokens backwards gives the encoding of any prefix, so bytes can be
appended without touching what is there, and an edit needs re-encoding only from where it begins.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from chronolith.session import spread

#: The pieces that text is cut into before encoding (contractions, letters, digits, other signs, white space).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by a worker; beyond this the oldest half is dropped. It bounds memory, not the result.
REMEMBERED = 400_000
#: Longer chunks (in characters) are encoded each time; they hardly repeat.
LONG = 200
UNPAIRED = regex.compile("[\ud800-\udfff]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens with their ids; a lower id is merged earlier."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merging by definition; used on one or two tokens at a time only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, t: int) -> bool:
        if (ok := self.own.get(t)) is None:
            ok = self.own[t] = self.merged(self.token[t]) == [t]
        return ok

    def compatible(self, a: int, b: int) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            ok = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return ok


class PrefixEncoding:
    """A piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extends the piece; prefixes known so far keep their tokens."""
        old, self.data = len(self.data), self.data + more
        data, last, n = self.data, self.last, len(self.data)
        last += [-1] * (n - old)
        ranks, starts, v = self.v.ranks, self.v.starts, self.v
        for s in range(max(0, old - self.v.longest), n):
            if s and last[s] < 0:
                continue
            before = last[s]
            for e in range(s + 1, n + 1):
                part = data[s:e]
                t = ranks.get(part)
                if t is not None and e > old and last[e] < 0 and (v.compatible(before, t) if s else v.reachable(t)):
                    last[e] = t
                if part not in starts:
                    break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Re-encodes from ``start``; the prefixes before it stay as they are."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new + tail)

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the prefix of that length, by default of all bytes."""
        e = len(self.data) if upto is None else upto
        out = []
        while e:
            t = self.last[e]
            out.append(t)
            e -= len(self.v.token[t])
        return out[::-1]


class Encoder:
    """Whole texts. A boundary between pieces lies before every space that precedes something else than white space,
    so texts are cut there first; of each distinct chunk the ids are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(PIECES).findall
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def chunk(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        ids: list[int] = []
        for p in self.find(text):
            if (x := self.pieces.get(p)) is None:
                # lone surrogates can't be UTF-8; they count as U+FFFD
                x = PrefixEncoding(self.v, UNPAIRED.sub("\ufffd", p).encode()).ids()
                if len(p) <= LONG:
                    self.pieces[p] = x
            ids += x
        if len(self.pieces) > REMEMBERED:
            self.pieces = dict(list(self.pieces.items())[REMEMBERED // 2 :])
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        known, out = self.known, []
        held = parts[0]
        chunks = []
        for p in parts[1:]:
            if p and not p[0].isspace():
                chunks.append(held)
                held = " " + p
            else:
                held += " " + p
        chunks.append(held)
        if len(known) > REMEMBERED:
            self.known = known = dict(list(known.items())[REMEMBERED // 2 :])
        for c in chunks:
            x = known.get(c)
            if x is None:
                x = self.chunk(c)
                if len(c) <= LONG:
                    known[c] = x
            out.append(x)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(load_ranks(path)))
    return _encoders[path]


def encode_corpus(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): every text as token ids, without special tokens; white space and the strings of special
    tokens are encoded like any text. Null and empty texts give an empty list. Rows are neither merged nor dropped, a
    null id stays null. ``vocabulary`` is a file of ranks that the driver sees; it is sent to the executors once. Nothing is shuffled
    but a table in fewer partitions than cores: each batch is encoded where it is read."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(name))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                codes = [e.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(c) // 4 for c in codes]], dtype="<i4")
                flat = pa.array(np.frombuffer(b"".join(codes), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[doc_id, "ids"])

    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"`{doc_id}` {kind}, ids array<int>")
