"""Greedy choice among the built-in model types for whole stretches of ticks, with numpy.

Each type takes ticks from a start until it refuses one, whatever the others do; so a segment is the best ratio among the longest
prefixes of all types, and the next one begins after it. The segments are those that ``generator`` makes tick by tick, which stays
for streams, splitting of groups and user-defined types.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from chronolith.models.types import CONE, FALLBACK, Gorilla, PMCMean, Swing, Uncompressed, assign_mtids
from chronolith.operators.generator import Settings

BUILT_IN = {PMCMean.name, Swing.name, Gorilla.name}
#: Ticks that are looked at first; doubled while a type takes them all.
LOOK = 64


def applies(settings: Settings) -> bool:
    return set(settings.models) <= BUILT_IN and not settings.split_fraction


def errors(approx: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Percentages as in ``models.types.error``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.abs(real - approx) / np.abs(real) * 100.0
    return np.where(approx == real, 0.0, np.where(real == 0, np.inf, e))


def f32(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.asarray(x).astype(np.float32).astype(np.float64)


@dataclass
class Made:
    """A segment: ticks [first, last) of its stretch, and each member's lowest and highest value and total."""

    first: int
    last: int
    mtid: int
    model: bytes
    c0: float
    c1: float
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


class Stretch:
    """Ticks without gap in which the same members have values."""

    def __init__(self, ts: np.ndarray, v: np.ndarray, settings: Settings):
        self.ts, self.v, self.n, self.w = ts, v, len(ts), v.shape[1]
        self.bound, self.limit, self.set = settings.error_bound, settings.length_bound, settings
        self.low, self.high, self.sum = v.min(1), v.max(1), np.cumsum(v, 1)[:, -1]
        self.room = np.abs(v) * (self.bound / CONE)
        self.raw = np.ascontiguousarray(v.astype(np.float32)).view(np.uint32)

    def longest(self, s: int, taken) -> tuple[int, object]:
        """Looks at ever more ticks from ``s`` until not all are taken; ``taken`` gives the number and what belongs to it."""
        look = LOOK
        while True:
            e = min(self.n, s + look)
            n, more = taken(s, e)
            if n < e - s or e == self.n:
                return n, more
            look *= 4

    def constant(self, s: int, e: int) -> tuple[int, np.ndarray]:
        count = np.arange(1, e - s + 1) * self.w
        mean = f32(np.cumsum(self.sum[s:e]) / count)
        ok = (errors(mean, np.minimum.accumulate(self.low[s:e])) <= self.bound) & (errors(mean, np.maximum.accumulate(self.high[s:e])) <= self.bound)
        return (e - s if ok.all() else int(ok.argmin())), mean

    def linear(self, s: int, e: int) -> tuple[int, tuple[float, float]]:
        """Number of ticks, and slope and start of the line."""
        a = float(f32(self.sum[s] / self.w))
        if (errors(np.float64(a), np.array([self.low[s], self.high[s]])) > self.bound).any():
            return 0, (0.0, a)
        if e - s < 2:
            return 1, (0.0, a)
        v, room, dt = self.v[s + 1 : e].ravel(), self.room[s + 1 : e].ravel(), np.repeat(self.ts[s + 1 : e] - self.ts[s], self.w)
        upper, lower = np.minimum.accumulate((v + room - a) / dt), np.maximum.accumulate((v - room - a) / dt)
        u, l = a + upper[:-1] * dt[1:], a + lower[:-1] * dt[1:]
        bad = (u + room[1:] < v[1:]) | (l - room[1:] > v[1:])
        n = 1 + ((int(bad.argmax()) + 1) // self.w if bad.any() else e - s - 1)
        return n, ((0.0 if n < 2 else float(upper[(n - 1) * self.w - 1] + lower[(n - 1) * self.w - 1]) / 2), a)

    def line_payload(self, s: int, n: int, a: float, b: float) -> bytes | None:
        """None if the line misses a value."""
        if n < 2:
            return None
        x = f32(b + a * (self.ts[s : s + n] - self.ts[s]))
        if (errors(np.repeat(x, self.w), self.v[s : s + n].ravel()) > self.bound).any():
            return None
        if float(f32(a)) == a and float(f32(b)) == b:
            return struct.pack(">ff", a, b)
        return struct.pack(">fd", a, b) if float(f32(a)) == a else struct.pack(">dd", a, b)

    def bits(self, s: int, n: int) -> list[str]:
        """Of the XOR encoding of n ticks."""
        raw = self.raw[s : s + n].ravel()
        x = raw[1:] ^ raw[:-1]
        _, exponent = np.frexp(x.astype(np.float64))
        lead = np.minimum(31, 32 - exponent)
        _, low = np.frexp((x & (~x + np.uint32(1))).astype(np.float64))
        out, wl, wt = [f"{int(raw[0]):032b}"], 33, 0
        for b, l, t in zip(x.tolist(), lead.tolist(), (low - 1).tolist()):
            if not b:
                out.append("0")
            elif l >= wl and t >= wt:
                out.append("10" + f"{b >> wt:0{32 - wl - wt}b}")
            else:
                k = 32 - l - t
                out.append("11" + f"{l:05b}{k:06b}{b >> t:0{k}b}")
                wl, wt = l, t
        return out

    def segments(self, gaps: int) -> list[Made]:
        ids, out, s = assign_mtids(self.set.models), [], 0
        ratio = lambda n, size: 16.0 * n / (24.0 + size + 4.0 * gaps)
        order = self.set.models or (FALLBACK,)
        while s < self.n:
            best, top, seen = None, 0.0, 0
            for name in dict.fromkeys(order):
                if name == PMCMean.name:
                    n, mean = self.longest(s, self.constant)
                    seen = max(seen, n)
                    if n and ratio(n, 4) >= top:
                        best, top = (name, n, mean), ratio(n, 4)
                elif name == Swing.name:
                    n, (a, b) = self.longest(s, self.linear)
                    seen = max(seen, n)
                    p = self.line_payload(s, n, a, b)
                    if p is not None and ratio(n, len(p)) >= top:
                        best, top = (name, n, (a, b, p)), ratio(n, len(p))
                else:
                    n = min(self.limit, self.n - s)
                    count = n * self.w
                    if name == FALLBACK:
                        size = 4 * count
                    elif ratio(n, (32 + count - 1 + 7) // 8) < top:
                        continue  # not even with one bit a value
                    else:
                        bits = self.bits(s, n)
                        size = (sum(map(len, bits)) + 7) // 8
                    if ratio(n, size) >= top:
                        best, top = (name, n, None if name == FALLBACK else bits), ratio(n, size)
            if best is None:  # what has been looked at when the last type refuses
                best = (FALLBACK, min(self.limit, self.n - s, seen + 1), None)
            out.append(self.made(s, *best, ids))
            s = out[-1].last
        return out

    def made(self, s: int, name: str, n: int, what, ids: dict[str, int]) -> Made:
        if name == PMCMean.name:
            model = struct.pack(">f", float(np.cumsum(self.sum[s : s + n])[-1]) / (n * self.w))
            c = struct.unpack(">f", model)[0]
            one = np.full(self.w, c)
            return Made(s, s + n, ids[name], model, c, 0.0, one, one, one * n)
        if name == Swing.name:
            a, b, model = what
            a, b = Swing.coefficients(model)
            x = f32(b + a * (self.ts[s : s + n] - self.ts[s]))
            return Made(s, s + n, ids[name], model, b, a, np.full(self.w, x.min()), np.full(self.w, x.max()), np.full(self.w, x.sum()))
        v = self.v[s : s + n]
        if name == Gorilla.name:
            joined = "".join(what)
            size = (len(joined) + 7) // 8
            model = int(joined.ljust(8 * size, "0"), 2).to_bytes(size, "big")
        else:
            model = v.astype(">f4").tobytes()
        return Made(s, s + n, ids[name], model, float(v[0, 0]), 0.0, v.min(0), v.max(0), v.sum(0))


def stretches(ts: np.ndarray, v: np.ndarray, si: int) -> list[tuple[int, int]]:
    """[from, to) of ticks in sequence with the same members present (not NaN); ticks without any must be left out before."""
    here = ~np.isnan(v)
    cut = (np.diff(ts) > si) | (here[1:] != here[:-1]).any(1)
    edges = np.r_[0, np.flatnonzero(cut) + 1, len(ts)] if len(ts) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def compress(ts: np.ndarray, v: np.ndarray, tids: tuple[int, ...], si: int, settings: Settings) -> list[tuple[int, int, tuple[int, ...], tuple[int, ...], Made]]:
    """(start, end, gaps, members, segment) for ticks in order of time; ``v`` is (ticks, members) with NaN where a member has
    no value."""
    some = ~np.isnan(v).all(1)
    ts, v = ts[some], v[some]
    out = []
    for a, b in stretches(ts, v, si):
        present = ~np.isnan(v[a])
        members = tuple(t for t, p in zip(tids, present) if p)
        gaps = tuple(t for t, p in zip(tids, present) if not p)
        for m in Stretch(ts[a:b], v[a:b][:, present], settings).segments(len(gaps)):
            out.append((int(ts[a + m.first]), int(ts[a + m.last - 1]), gaps, members, m))
    return out
