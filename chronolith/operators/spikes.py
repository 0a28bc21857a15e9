"""Readings that are spikes, stuck or physically impossible, relative to the normal course of their source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.grid import DAY_MS, PERIODS_MS
from chronolith.operators.readings import with_source
from chronolith.session import millis, written

#: Readings of a source that are fitted and judged together, on average.
BLOCK = 8192
#: Readings next to a block's edge that are judged with the readings beyond it, and the blocks that are looked through for them.
EDGE, REACH = 16, 16
#: Readings on either side whose median is the course there, those whose median is a level, and the longest spike.
SIDE, LEVEL, LONGEST = 5, 7, 3
#: Chance that an ordinary reading exceeds the cutoff.
RISK = 1e-5
#: Tails of residuals and of moves from level to level: the share of the sample above the threshold, the bounds of the shape
#: (residuals' tails are near exponential, moves are bounded), and the peaks at which the estimated shape counts half.
RESIDUAL_TAIL = (0.1, (-0.1, 0.1), 40)
MOVE_TAIL = (0.3, (-1.0, 0.0), 5)
#: Stuck: at least so many equal readings, and so many times the longest other stretch.
STUCK, STUCK_TIMES = 40, 4


class Blocks:
    """Columns sorted by block, with shifts that stay inside a block."""

    def __init__(self, block: np.ndarray):
        self.n = len(block)
        self.first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if self.n else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[self.first, self.n])
        self.of = np.repeat(np.arange(len(self.first)), self.size)

    def shift(self, x: np.ndarray, by: int, fill: float) -> np.ndarray:
        out = np.full(self.n, fill, np.result_type(x, type(fill)))
        if abs(by) < self.n:
            to, frm = (slice(None, self.n - by), slice(by, None)) if by >= 0 else (slice(-by, None), slice(None, self.n + by))
            out[to] = np.where(self.of[to] == self.of[frm], x[frm], fill)
        return out

    def quantile(self, x: np.ndarray, q: float, ok: np.ndarray) -> np.ndarray:
        """Of the rows of each block where ``ok``, as one value a block; 0 where there are none."""
        of, y = self.of[ok], x[ok]
        o = np.lexsort((y, of))
        size = np.bincount(of, minlength=len(self.first))
        start = np.r_[0, np.cumsum(size)[:-1]]
        at = start + np.clip(np.ceil(q * size).astype(int) - 1, 0, np.maximum(size - 1, 0))
        return np.where(size > 0, y[o][np.minimum(at, max(0, len(y) - 1))] if len(y) else 0.0, 0.0)


def middle(cols: list[np.ndarray]) -> np.ndarray:
    """Row-wise median of what is finite, NaN without any. Columns are sorted against each other, so no row is handled alone."""
    m = [np.where(np.isnan(c), np.inf, c) for c in cols]
    k = len(m)
    finite = sum(np.isfinite(c).astype(np.int8) for c in m)
    for step in range(k):  # odd-even transposition
        for i in range(step % 2, k - 1, 2):
            m[i], m[i + 1] = np.minimum(m[i], m[i + 1]), np.maximum(m[i], m[i + 1])
    out = (m[(k - 1) // 2] + m[k // 2]) / 2
    few = np.flatnonzero(finite < k)
    if len(few):
        part, n = np.stack([c[few] for c in m], 1), finite[few].astype(int)
        r, n1 = np.arange(len(few)), np.maximum(n, 1)
        out[few] = np.where(n > 0, (part[r, (n1 - 1) // 2] + part[r, n1 // 2]) / 2, np.nan)
    return out


def waves(ts: np.ndarray) -> list[np.ndarray]:
    """A sine and a cosine for each period of the seasonal regression."""
    return [f((ts % p) * (2 * math.pi / p)) for p in PERIODS_MS for f in (np.sin, np.cos)]


def seasonal(b: Blocks, ts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Coefficients of the waves, a row a block: least squares with constant and trend, from the normal equations of each
    block. A ridge of one reading's weight holds down what a short block doesn't determine."""
    t = (ts - ts[b.first][b.of]) / DAY_MS
    span = np.maximum.reduceat(t, b.first)
    x = [np.ones(b.n), t / np.maximum(span[b.of], 1e-9) - 0.5, *waves(ts)]
    y = v - (np.add.reduceat(v, b.first) / b.size)[b.of]
    k = len(x)
    a, c = np.empty((len(b.first), k, k)), np.empty((len(b.first), k))
    for i in range(k):
        for j in range(i, k):
            a[:, i, j] = a[:, j, i] = np.add.reduceat(x[i] * x[j], b.first)
        c[:, i] = np.add.reduceat(x[i] * y, b.first)
    i = np.arange(k)
    a[:, i, i] += 1e-6 * b.size[:, None] + (i > 0)
    return np.linalg.solve(a, c[:, :, None])[:, 2:, 0]


def without_season(ts: np.ndarray, v: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """``beta`` has a row for each reading."""
    return v - sum(w * beta[:, k] for k, w in enumerate(waves(ts)))


def tail_cutoff(y: np.ndarray, b: Blocks, sample: np.ndarray, tail: tuple[float, tuple[float, float], int]) -> np.ndarray:
    """Per block the value that a reading exceeds with chance RISK where ``y`` follows the law of its ``sample``: peaks over the
    threshold u, which a share of the sample exceeds, follow a generalised Pareto law. Its scale and shape come from the
    quartiles of the peaks, which the few true spikes among them hardly move; the fewer the peaks, the nearer the shape is to
    0. Where hardly any reading differs from 0, all that do are the peaks."""
    share, bounds, trusted = tail
    u = b.quantile(y, 1 - share, sample)
    peaks = sample & (y > u[b.of])
    over = np.where(peaks, y - u[b.of], 0.0)
    half, upper = b.quantile(over, 0.5, peaks), b.quantile(over, 0.75, peaks)
    many = np.bincount(b.of[peaks], minlength=len(b.first))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        k = np.clip(np.log2(np.maximum(upper - half, 1e-300) / np.maximum(half, 1e-300)), *bounds)
        k = k * many / (many + trusted)
        k = np.where(np.abs(k) < 1e-3, 1e-3, k)
        scale = np.where(half > 0, half * k / (2.0**k - 1), 0.0)
        return u + scale / k * (np.minimum(1.0, RISK / (np.maximum(many, 1) / b.size)) ** -k - 1)


def excursions(b: Blocks, v: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """How far each reading lies beyond the medians of both sides, with all of an excursion of 1 to LONGEST readings, whose
    neighbours have returned at least halfway. Readings marked in ``without`` don't count in the medians."""
    course = v if without is None else np.where(without, np.inf, v)
    before = middle([b.shift(course, -o, np.inf) for o in range(1, SIDE + 1)])
    after = middle([b.shift(course, o, np.inf) for o in range(1, SIDE + 1)])
    residual = np.zeros(b.n)
    for length in range(1, LONGEST + 1):
        end = b.shift(after, length - 1, np.nan)
        low, high = np.fmin(before, end), np.fmax(before, end)
        up, down = np.full(b.n, np.inf), np.full(b.n, np.inf)
        for k in range(length):
            x = b.shift(v, k, np.nan)
            up, down = np.fmin(up, np.nan_to_num(x - high, nan=-1.0)), np.fmin(down, np.nan_to_num(low - x, nan=-1.0))
        prior, later = b.shift(v, -1, np.nan), b.shift(v, length, np.nan)
        up = np.where(np.fmax(prior, later) - high < up / 2, up, 0)
        down = np.where(low - np.fmin(prior, later) < down / 2, down, 0)
        out = np.where(np.isfinite(before) & np.isfinite(end), np.maximum(np.maximum(up, down), 0), 0)
        for k in range(length):
            residual = np.maximum(residual, b.shift(out, -k, 0.0))
    return residual


def moves(b: Blocks, v: np.ndarray) -> np.ndarray:
    """How far the level moves at each reading: between the medians of LEVEL readings before and from it on, which no
    excursion of LONGEST readings turns."""
    before = middle([b.shift(v, -o, np.inf) for o in range(1, LEVEL + 1)])
    return np.nan_to_num(np.abs(middle([b.shift(v, o, np.inf) for o in range(LEVEL)]) - before))


def cutoffs(b: Blocks, e: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Per block what an excursion must exceed: at the fixed RISK neither the tail of the source's excursions nor that of its
    lasting moves from level to level reaches it."""
    moved = moves(b, e)
    largest = moved > 0  # a move shows at all readings within LEVEL: its largest counts
    for k in range(1, LEVEL + 1):
        largest &= (moved > b.shift(moved, -k, -1.0)) & (moved >= b.shift(moved, k, -1.0))
    every = np.ones(b.n, bool)
    return np.maximum(tail_cutoff(residual, b, every, RESIDUAL_TAIL), tail_cutoff(moved, b, largest, MOVE_TAIL))


def beyond(b: Blocks, e: np.ndarray, residual: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Marks excursions beyond ``cut`` (a value a reading), and looks once more without the marked readings in the medians:
    what stood out only against a spike beside it is none."""
    hit = (residual > cut) & (residual > 0)
    near = np.zeros(b.n, bool)
    marked = np.flatnonzero(hit)
    for k in range(-2 * SIDE, 2 * SIDE + 1):
        near[np.clip(marked + k, 0, b.n - 1)] = True
    at = np.flatnonzero(near)  # all that the marked readings' medians see, stretch by stretch
    if len(at):
        stretch = np.cumsum(np.r_[0, (np.diff(at) > 1) | (b.of[at][1:] != b.of[at][:-1])])
        hit[at] &= excursions(Blocks(stretch), e[at], hit[at]) > cut[at]
    return hit


def spikes(block: np.ndarray, ts: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marks, cutoff of each block, seasonal coefficients of each block) of readings sorted by block and time.

    A harmonic regression takes the season from each block. What is left is judged against its course on both sides, and
    peaks over threshold of these residuals set the block's cutoff at the fixed RISK; see ``cutoffs``. Slow changes and
    lasting changes of level leave no residual. Blocks of few readings have too few peaks for any to lie beyond the cutoff."""
    b = Blocks(block)
    beta = seasonal(b, ts, v)
    e = without_season(ts, v, beta[b.of])
    residual = excursions(b, e)
    cut = cutoffs(b, e, residual)
    return beyond(b, e, residual, cut[b.of]), cut, beta


#: What ``judge`` finds, as rows of one table: times of impossible readings and of spikes, parts of equal stretches, edges.
IMPOSSIBLE, SPIKE, STRETCH, BORDER = range(4)
FOUND = "kind int, tid int, blk int, first_ms long, last_ms long, v float, n long, at_first boolean, at_last boolean, times array<long>, vals array<double>, fit array<double>"
SCHEMA = pa.schema([("kind", pa.int32()), ("tid", pa.int32()), ("blk", pa.int32()), ("first_ms", pa.int64()), ("last_ms", pa.int64()), ("v", pa.float32()), ("n", pa.int64()), ("at_first", pa.bool_()), ("at_last", pa.bool_()), ("times", pa.list_(pa.int64())), ("vals", pa.list_(pa.float64())), ("fit", pa.list_(pa.float64()))])


class Found:
    """Rows of FOUND, kept as columns."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, tid: int, blk: int, times: np.ndarray, vals=None, fit=None, first=None, last=None, v=None, n=None, at_first=None, at_last=None) -> None:
        self.rows.append((kind, tid, blk, first, last, v, n, at_first, at_last, times, vals, fit))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * len(SCHEMA)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def judged(tid: np.ndarray, blk: np.ndarray, ts: np.ndarray, v: np.ndarray, bad: np.ndarray) -> pa.RecordBatch:
    """Of whole blocks, sorted by (tid, blk, ts, v). ``blk`` is -1 for a source of one block; ``v`` is NaN where unusable."""
    once = np.r_[(tid[1:] != tid[:-1]) | (ts[1:] != ts[:-1]), True]  # the last copy has the largest usable value
    tid, blk, ts, v, bad = tid[once], blk[once], ts[once], v[once], bad[once]
    out = Found()
    key = tid.astype(np.int64) << 32 | (blk.astype(np.int64) & 0xFFFFFFFF)
    b = Blocks(key)
    for k in np.unique(b.of[bad]):
        of = slice(b.first[k], b.first[k] + b.size[k])
        out.add(IMPOSSIBLE, int(tid[b.first[k]]), int(blk[b.first[k]]), ts[of][bad[of]])
    stretches(out, b, tid, blk, ts, v)
    good = ~bad & ~np.isnan(v)
    if good.any():
        tid, blk, ts, v, key = tid[good], blk[good], ts[good], v[good].astype(float), key[good]
        hit, cut, beta = spikes(key, ts, v)
        b = Blocks(key)
        at = np.arange(b.n) - b.first[b.of]
        single = blk < 0
        inner = single | ((at >= EDGE) & (at < b.size[b.of] - EDGE) & (b.size[b.of] > 4 * EDGE))
        hit &= inner
        for k in np.unique(b.of[hit]):
            of = slice(b.first[k], b.first[k] + b.size[k])
            out.add(SPIKE, int(tid[b.first[k]]), int(blk[b.first[k]]), ts[of][hit[of]])
        for k in np.flatnonzero(~single[b.first]):
            i, j = b.first[k], b.first[k] + b.size[k]
            keep = np.r_[i : i + 2 * EDGE, j - 2 * EDGE : j] if b.size[k] > 4 * EDGE else np.r_[i:j]
            out.add(BORDER, int(tid[i]), int(blk[i]), ts[keep], v[keep], np.r_[cut[k], beta[k]], int(ts[i]), int(ts[j - 1]), n=int(b.size[k]))
    return out.batch()


def stretches(out: Found, b: Blocks, tid: np.ndarray, blk: np.ndarray, ts: np.ndarray, v: np.ndarray) -> None:
    """Adds stretches of one exact value: those at an edge of their block, those of at least STUCK readings, and of the others
    the longest of each block. Unusable readings stand alone."""
    same = np.r_[False, (v[1:] == v[:-1]) & (b.of[1:] == b.of[:-1])]
    first = np.flatnonzero(~same)
    size = np.diff(np.r_[first, b.n])
    of = b.of[first]
    at_first, at_last = first == b.first[of], first + size == (b.first + b.size)[of]
    usable = ~np.isnan(v[first])
    inner = np.flatnonzero(usable & ~at_first & ~at_last & (size < STUCK))
    o = inner[np.lexsort((size[inner], of[inner]))]
    longest = o[np.r_[of[o][1:] != of[o][:-1], True]] if len(o) else o
    keep = np.flatnonzero(at_first | at_last | (usable & (size >= STUCK)))
    for k in np.sort(np.r_[keep, longest]):
        i, j = first[k], first[k] + size[k]
        held = ts[i:j] if usable[k] and (size[k] >= STUCK or blk[i] >= 0) else ts[i:i]
        out.add(STRETCH, int(tid[i]), int(blk[i]), held, None, None, int(ts[i]), int(ts[j - 1]), float(v[i]) if usable[k] else None, int(size[k]), bool(at_first[k]), bool(at_last[k]))


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (tid, blk, ts_ms, v) to rows of FOUND. Many blocks are judged at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for x in batches:
        if not x.num_rows:
            continue
        held.append(tuple(x.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
        rows += x.num_rows
        if rows >= 1 << 18:
            cols = tuple(map(np.concatenate, zip(*held)))
            tid, blk = cols[0], cols[1]
            other = np.flatnonzero((tid != tid[-1]) | (blk != blk[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield judged(*(c[:cut] for c in cols))
            held, rows = [tuple(c[cut:] for c in cols)], len(tid) - cut
    if rows:
        yield judged(*map(np.concatenate, zip(*held)))


def at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tid, times, vals, n, fit, before_t, before_v, after_t, after_v) of blocks with the readings next to them, to
    (tid, ts_ms) of the spikes that ``judged`` left open."""
    for x in batches:
        owner, ts, v, own, fits, tids = [], [], [], [], [], []
        for r in x.to_pylist():
            t, y = np.array(r["times"], np.int64), np.array(r["vals"], float)
            lt, lv, rt, rv = (np.array(r[c] or [], k) for c, k in (("before_t", np.int64), ("before_v", float), ("after_t", np.int64), ("after_v", float)))
            parts = [(t, y, 0, len(t))] if r["n"] <= 4 * EDGE else [(t[: 2 * EDGE], y[: 2 * EDGE], 0, EDGE), (t[2 * EDGE :], y[2 * EDGE :], EDGE, 2 * EDGE)]
            for k, (pt, pv, lo, hi) in enumerate(parts):
                left = (lt, lv) if k == 0 else (lt[:0], lv[:0])
                right = (rt, rv) if k == len(parts) - 1 else (rt[:0], rv[:0])
                mine = np.zeros(len(left[0]) + len(pt) + len(right[0]), bool)
                mine[len(left[0]) + lo : len(left[0]) + hi] = True
                ts.append(np.r_[left[0], pt, right[0]]), v.append(np.r_[left[1], pv, right[1]]), own.append(mine)
                owner.append(np.full(len(mine), len(owner))), fits.append(r["fit"]), tids.append(r["tid"])
        if not owner:
            continue
        of, ts, v, own = (np.concatenate(c) for c in (owner, ts, v, own))
        fit = np.array(fits)[of]
        b = Blocks(of)
        e = without_season(ts, v, fit[:, 1:])
        hit = beyond(b, e, excursions(b, e), fit[:, 0]) & own
        yield pa.RecordBatch.from_arrays([pa.array(np.array(tids, np.int32)[of[hit]], pa.int32()), pa.array(ts[hit], pa.int64())], names=["tid", "ts_ms"])


def border_spikes(found: DataFrame) -> DataFrame:
    """(tid, ts_ms): spikes near the edges of blocks, judged with the block's own fit and the readings beyond the edge. One row
    a block is ordered within its source."""
    w = Window.partitionBy("tid").orderBy("blk")
    pairs = F.arrays_zip("times", "vals")
    near = lambda frame: F.flatten(F.collect_list(pairs).over(frame))
    x = found.where(F.col("kind") == BORDER).select("tid", "blk", "times", "vals", "n", "fit", near(w.rowsBetween(-REACH, -1)).alias("l"), near(w.rowsBetween(1, REACH)).alias("r"))
    x = x.withColumns({"l": F.slice("l", F.greatest(F.size("l") - 2 * EDGE + 1, F.lit(1)), 2 * EDGE), "r": F.slice("r", 1, 2 * EDGE)})
    x = x.select("tid", "times", "vals", "n", "fit", *[F.col(f"{s}.{c}").alias(f"{name}_{c[0]}") for s, name in (("l", "before"), ("r", "after")) for c in ("times", "vals")])
    return x.mapInArrow(at_borders, "tid int, ts_ms long")


def stuck(found: DataFrame) -> DataFrame:
    """(tid, ts_ms): readings of stuck stretches. Parts at the edges of successive blocks are chained first. Per tid, lengths
    are gone through from the longest down; those at least STUCK long above the last one that is STUCK_TIMES the next are
    stuck."""
    c = F.col
    w = Window.partitionBy("tid").orderBy("first_ms")  # a few rows a block
    parts = found.where(c("kind") == STRETCH).select("tid", "first_ms", "v", "n", "at_first", "at_last", "times")
    before = F.lag(F.struct("v", "at_last")).over(w)
    parts = parts.withColumn("p", before)
    joins = c("at_first") & F.coalesce(c("p")["at_last"] & (c("p")["v"] == c("v")), F.lit(False))
    parts = parts.withColumn("chain", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    parts = parts.withColumn("total", F.sum("n").over(Window.partitionBy("tid", "chain"))).where("v is not null").select("tid", "total", "times")
    parts = written(parts, "stretches")  # a few rows a block, read twice
    sizes = parts.select("tid", "total").distinct()
    sizes = sizes.withColumn("next", F.coalesce(F.lead("total").over(Window.partitionBy("tid").orderBy(F.desc("total"))), F.lit(0)))
    least = sizes.where((c("total") >= STUCK) & (c("total") >= STUCK_TIMES * c("next"))).groupBy("tid").agg(F.min("total").alias("least"))
    return parts.join(least, "tid").where("total >= least").select("tid", F.explode("times").alias("ts_ms"))


def implausible(df: DataFrame, series: DataFrame, limits: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tid, ts_ms, impossible, spike, stuck): every usable reading that is at least one of the three, once.

    *Impossible* lies outside the limits of its series' measure; without a known measure or limit there is none. *Stuck*
    belongs to a stretch of one exact value of at least STUCK readings, STUCK_TIMES as long as any stretch of the tid that
    isn't stuck. *Spike*: see ``spikes``; impossible readings don't count there. Copies of a reading count once (of differing
    ones the largest usable value), unusable readings are never flagged, rows with a null tid or timestamp are left out, an
    empty table gives no rows.

    A first look counts readings and their span by source. A source is then cut into blocks of equal time that hold about
    ``block`` readings each, so a hot source is spread over many tasks and its normal behaviour is that around the reading. One
    exchange brings the readings of a block together; that pass finds all but what crosses the edges of blocks, for which
    it leaves a few readings and stretches a block.
    """
    tid, ts = F.col("tid").cast("int"), millis("timestamp")
    rows = df.select(tid.alias("tid"), ts.alias("ts_ms"), F.col("value").cast("float").alias("v")).where("tid is not null and ts_ms is not null")
    span = rows.groupBy("tid").agg(F.count(F.lit(1)).alias("many"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    known = limits.where("measure is not null").groupBy("measure").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    bounds = series.where("tid is not null").select(tid.alias("tid"), "measure").join(known, "measure").groupBy("tid").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    pieces = F.ceil(F.col("many") / block)
    source = span.join(bounds, "tid", "left").select("tid", "low", "high", "lo", pieces.alias("pieces"), F.ceil((F.col("hi") - F.col("lo") + 1) / pieces).alias("width"))
    source = written(source, "sources")  # a row a source, counted and read again
    rows = with_source(rows, source, "tid")
    v = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    bad = F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False))
    blk = F.when(F.col("pieces") == 1, -1).otherwise(F.floor((F.col("ts_ms") - F.col("lo")) / F.col("width"))).cast("int")
    rows = rows.select("tid", blk.alias("blk"), "ts_ms", v.alias("v"), bad.alias("bad"))
    placed = rows.repartition("tid", "blk").sortWithinPartitions("tid", "blk", "ts_ms", "v")
    found = written(placed.mapInArrow(judge, FOUND), "judged")  # small, read by what follows

    one = lambda kind: found.where(F.col("kind") == kind).select("tid", F.explode("times").alias("ts_ms"))
    flags = {"impossible": one(IMPOSSIBLE), "spike": one(SPIKE).unionByName(border_spikes(found)), "stuck": stuck(found)}
    every = None
    for why, x in flags.items():
        x = x.withColumn("why", F.lit(why))
        every = x if every is None else every.unionByName(x)
    return every.groupBy("tid", "ts_ms").agg(*[F.max(F.col("why") == w).alias(w) for w in flags])
