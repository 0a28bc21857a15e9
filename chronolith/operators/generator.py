"""Ticks of one group to segments: greedy choice among model types, gaps, bounded latency, splitting and joining."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from chronolith.models.types import DEFAULT, FALLBACK, REGISTRY, Gorilla, Swing, Uncompressed, assign_mtids, error


@dataclass
class Settings:
    """Bounds and thresholds of ingestion."""

    error_bound: float = 0.0
    length_bound: int = 50
    maximum_latency: int = 0
    split_fraction: float = 0.0
    models: tuple[str, ...] = DEFAULT

    def types(self) -> list:
        """Those to try in order; the fallback where none is named."""
        ids = assign_mtids(self.models)
        return [REGISTRY[n](ids[n], self.error_bound, self.length_bound) for n in self.models or (FALLBACK,)]

    def fallback(self):
        return REGISTRY[FALLBACK](1, self.error_bound, self.length_bound)


@dataclass
class Segment:
    start: int
    end: int
    mtid: int
    model: bytes
    gaps: tuple[int, ...]
    members: tuple[int, ...]
    ticks: list[tuple[int, tuple]]
    final: bool = True


def pack_gaps(gaps: tuple[int, ...]) -> bytes:
    return struct.pack(f">{len(gaps)}i", *gaps)


class Generator:
    """Consumes ticks (time, value or None for each member) of a group in order of time. ``out`` collects segments."""

    def __init__(self, tids: tuple[int, ...], si: int, settings: Settings, group: tuple[int, ...] | None = None):
        self.tids, self.si, self.set, self.group = tids, si, settings, group or tids
        self.buffer: list[tuple[int, tuple]] = []
        self.active: tuple[int, ...] = ()
        self.types, self.at, self.last = settings.types(), 0, None
        self.waiting = 0  # ticks since the last emission, temporary ones included
        self.ratios = [0.0, 0]
        self.splits: list[Generator] = []
        self.emitted, self.next_join = 0, 1
        self.out: list[Segment] = []

    def consume(self, ts: int, values: tuple) -> None:
        if self.splits:
            self.route(ts, values)
            return
        present = tuple(t for t, v in zip(self.tids, values) if v is not None)
        if self.last is not None and (ts - self.last > self.si or present != self.active):
            self.flush()  # a member's gap begins or ends
        if not present:
            return
        self.active, self.last = present, ts
        tick = (ts, tuple(v for v in values if v is not None))
        self.buffer.append(tick)
        self.waiting += 1
        if not self.types[self.at].append(*tick):
            self.advance(final=False)
        if self.set.maximum_latency and self.waiting >= self.set.maximum_latency and self.buffer:
            self.temporary()

    def advance(self, final: bool) -> None:
        """The current type has refused: tries those after it on the whole buffer, emits when all have."""
        while self.buffer:
            self.at += 1
            while self.at < len(self.types):
                self.types[self.at].start(self.buffer)
                if self.types[self.at].length >= len(self.buffer) and not final:
                    return
                self.at += 1
            self.emit(final)
            self.at = 0
            self.types[0].start(self.buffer)
            if not final and self.types[0].length >= len(self.buffer):
                return

    def gaps(self) -> tuple[int, ...]:
        return tuple(t for t in self.group if t not in self.active)

    def best(self):
        gaps, best, top = len(self.gaps()), None, 0.0
        for m in self.types:
            r = m.ratio(gaps)
            if r == r and r >= top:  # a tie goes to the later type; types that can't are passed over
                best, top = m, r
        if best is None or not best.length:
            best = self.set.fallback()
            best.start(self.buffer)
            top = best.ratio(gaps)
        return best, top

    def emit(self, final: bool) -> None:
        model, ratio = self.best()
        taken, self.buffer = self.buffer[: model.length], self.buffer[model.length :]
        self.out.append(Segment(taken[0][0], taken[-1][0], model.mtid, model.payload(), self.gaps(), self.active, taken))
        self.waiting, self.emitted = len(self.buffer), self.emitted + 1
        self.ratios = [self.ratios[0] + ratio, self.ratios[1] + 1]
        low = ratio < self.set.split_fraction * self.ratios[0] / self.ratios[1]
        if not final and low and self.buffer and len(self.active) > 1:
            self.split()

    def temporary(self) -> None:
        model = self.types[self.at] if self.at < len(self.types) else self.set.fallback()
        if model.length < len(self.buffer) or model.size() != model.size():
            model = self.set.fallback()
            model.limit = len(self.buffer)
            model.start(self.buffer)
        self.out.append(Segment(self.buffer[0][0], self.buffer[model.length - 1][0], model.mtid, model.payload(), self.gaps(), self.active, self.buffer[: model.length], False))
        self.waiting = 0

    def snapshot(self) -> list[Segment]:
        """Temporary segments of what is buffered, where that is as much as the latency allows."""
        out = [x for s in self.splits for x in s.snapshot()]
        if self.set.maximum_latency and len(self.buffer) >= self.set.maximum_latency:
            held, self.out = self.out, []
            waiting = self.waiting
            self.temporary()
            out, self.out, self.waiting = out + self.out, held, waiting
        return out

    def flush(self) -> None:
        """Emits all that is buffered."""
        for s in self.splits:
            s.flush()
            self.out += s.take()
        if self.buffer:
            self.at = max(self.at, 0)
            for m in self.types:
                m.start(self.buffer)
            self.at = len(self.types) - 1
            self.advance(final=True)
        self.buffer, self.at = [], 0
        self.types[0].clear()

    def take(self) -> list[Segment]:
        out, self.out = self.out, []
        return out

    # Members that no longer move together are handled apart until they do again.

    def close(self, a: list[float], b: list[float]) -> bool:
        return all(error(x, y) <= 2 * self.set.error_bound for x, y in zip(a, b))

    def split(self) -> None:
        columns = {t: [v[k] for _, v in self.buffer] for k, t in enumerate(self.active)}
        rest, parts = list(self.active), []
        while rest:
            parts.append([t for t in rest if self.close(columns[t], columns[rest[0]])])
            rest = [t for t in rest if t not in parts[-1]]
        missing = [t for t in self.tids if t not in self.active]
        if len(parts) < 2:
            return
        buffer, self.buffer, self.at = self.buffer, [], 0
        active = self.active
        for p in parts + [missing] * bool(missing):
            g = Generator(tuple(p), self.si, self.set, self.group)
            g.ratios = list(self.ratios)
            self.splits.append(g)
            if p is not missing:
                for ts, values in buffer:
                    g.consume(ts, tuple(v for t, v in zip(active, values) if t in p))
                self.out += g.take()

    def route(self, ts: int, values: tuple) -> None:
        of = dict(zip(self.tids, values))
        for s in self.splits:
            s.consume(ts, tuple(of[t] for t in s.tids))
            self.out += s.take()
        due = [s for s in self.splits if s.emitted >= s.next_join]
        for s in due:
            s.next_join = max(1, 2 * s.next_join)
            s.emitted = 0
            if s in self.splits:
                self.rejoin(s)

    def rejoin(self, s: "Generator") -> None:
        """Joins the splits whose buffered values, from the last backwards, are close to those of ``s``."""
        def recent(g: Generator) -> list[float]:
            return [v[0] for _, v in reversed(g.buffer)]

        mates = [g for g in self.splits if g is not s and g.last == s.last and g.buffer and s.buffer and self.close(recent(g), recent(s))]
        if not mates:
            return
        for g in [s, *mates]:
            g.flush()
            self.out += g.take()
            self.splits.remove(g)
        members = tuple(t for t in self.tids if t in {t for g in [s, *mates] for t in g.tids})
        if members == self.tids and not self.splits:
            self.last, self.active = None, ()
            return
        self.splits.append(Generator(members, self.si, self.set, self.group))


def compress(ticks: list[tuple[int, tuple]], tids: tuple[int, ...], si: int, settings: Settings) -> list[Segment]:
    g = Generator(tids, si, settings)
    for ts, values in ticks:
        g.consume(ts, values)
    g.flush()
    return g.take()


def stored(gid: int, si: int, s: Segment, swing_id: int) -> tuple:
    """A row of the stored segment table: the segment, and what lets queries aggregate it without decoding."""
    if REGISTRY.get(NAMES.get(s.mtid)) in LOSSLESS:
        values = np.array([v for _, v in s.ticks], np.float32)
    else:
        values = DECODERS[s.mtid](s.model, len(s.ticks), len(s.members), si)
    c1, c0 = Swing.coefficients(s.model) if s.mtid == swing_id else (0.0, float(values[0, 0]))
    stats = [(t, float(values[:, k].min()), float(values[:, k].max()), float(values[:, k].astype(float).sum())) for k, t in enumerate(s.members)]
    return (gid, s.start, s.end, s.mtid, s.model, pack_gaps(s.gaps), si, list(s.gaps), list(s.members), 0, float(c0), float(c1), stats, s.final)


DECODERS: dict = {}
NAMES: dict[int, str] = {}
LOSSLESS = (Uncompressed, Gorilla)


def use(models: tuple[str, ...], classes: dict | None = None) -> int:
    """Sets the decoders of these types' ids, with user-defined ``classes`` that a worker doesn't know; returns the id of the
    linear type, 0 without it."""
    REGISTRY.update(classes or {})
    ids = assign_mtids(models)
    DECODERS.clear()
    NAMES.clear()
    NAMES.update({i: n for n, i in ids.items()})
    DECODERS.update({i: REGISTRY[n].decode for n, i in ids.items()})
    return ids.get(Swing.name, 0)
