import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.models.types import Gorilla, PMCMean, Swing, Uncompressed, assign_mtids, error, register_model, ModelType, REGISTRY
from chronolith.operators import vectorised
from chronolith.operators.generator import DECODERS, Generator, Settings, compress, stored, use


def fill(m, values, si=1):
    for k, v in enumerate(values):
        if not m.append(k * si, v if isinstance(v, tuple) else (v,)):
            break
    return m


def test_golden_vectors():
    assert fill(PMCMean(2, 10, 50), [10.0, 11.0]).payload().hex() == "41280000"
    assert fill(PMCMean(2, 0, 50), [1.0, 2.0]).length == 1
    assert fill(PMCMean(2, 100, 50), [0.0, 1.0]).length == 1
    assert fill(Gorilla(4, 0, 50), [1.0, 1.0]).payload().hex() == "3f80000000"
    assert fill(Gorilla(4, 0, 50), [1.0, 2.0]).payload().hex() == "3f800000c247f8"
    assert fill(Uncompressed(1, 0, 50), [1.0, 2.0]).payload().hex() == "3f80000040000000"
    assert fill(Swing(3, 0, 50), [1.0, 2.0], 2).payload().hex() == "3f0000003f800000"
    assert abs(fill(PMCMean(2, 0, 50), [5.0] * 50).ratio(0) - 800 / 28) < 1e-9


def test_swing_sizes():
    assert len(fill(Swing(3, 0, 50), [1.0, 1.5]).payload()) == 8
    long = fill(Swing(3, 10, 50), [1.0, 1.1, 1.25, 1.3])
    assert len(long.payload()) in (12, 16) and long.size() == len(long.payload())


def test_bounds_and_registry():
    with pytest.raises(ValueError):
        PMCMean(2, 101, 50)
    assert assign_mtids(("gorilla", "pmc_mean", "gorilla")) == {"uncompressed": 1, "gorilla": 2, "pmc_mean": 3}
    with pytest.raises(ValueError):
        assign_mtids(("uncompressed",))

    @register_model
    class Own(Uncompressed):
        name = "own"

    assert REGISTRY["own"] is Own and issubclass(Own, ModelType)
    del REGISTRY["own"]


floats = st.floats(width=32, allow_nan=False, allow_infinity=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(floats, floats), min_size=1, max_size=50))
def test_gorilla_is_exact(ticks):
    m = fill(Gorilla(4, 0, 50), ticks)
    back = Gorilla.decode(m.payload(), len(ticks), 2, 1)
    assert back.tobytes() == np.array(ticks, np.float32).tobytes()


def series(seed, width, n, gap):
    rng = np.random.default_rng(seed)
    base = np.round(np.cumsum(rng.normal(0, 1, n)) + 20, rng.integers(0, 3))
    base[n // 3 : n // 2] = 5.0
    out = []
    for k in range(n):
        if rng.random() < gap / 4:
            continue
        out.append((k * 100, tuple(None if rng.random() < gap else float(np.float32(base[k] + (rng.normal(0, 3) if w and seed % 2 else 0))) for w in range(width))))
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.sampled_from([0, 1, 5, 10]), st.sampled_from([1, 7, 50]), st.sampled_from([0.0, 0.1]), st.sampled_from([0.0, 0.5, 2.0]), st.sampled_from([0, 3]))
def test_every_point_within_bound_once(seed, width, bound, length, gap, split, latency):
    ticks = series(seed, width, 120, gap)
    tids, conf = tuple(range(1, width + 1)), Settings(bound, length, latency, split)
    swing = use(conf.models)
    seen = {}
    for s in compress(ticks, tids, 100, conf):
        if not s.final:
            continue
        assert set(s.gaps) | set(s.members) == set(tids) and not set(s.gaps) & set(s.members)
        n = (s.end - s.start) // 100 + 1
        values = DECODERS[s.mtid](s.model, n, len(s.members), 100)
        for i in range(n):
            for k, t in enumerate(s.members):
                assert (t, s.start + i * 100) not in seen
                seen[t, s.start + i * 100] = float(values[i, k])
        row = stored(7, 100, s, swing)
        assert [x[0] for x in row[12]] == list(s.members) and abs(row[12][0][3] - values[:, 0].astype(float).sum()) < 1e-3 * max(1, abs(row[12][0][3]))
    want = {(t, ts): v for ts, vs in ticks for t, v in zip(tids, vs) if v is not None}
    assert seen.keys() == want.keys()
    assert all(error(seen[k], v) <= bound + 1e-9 for k, v in want.items())


def test_temporary_covers_what_waits():
    g = Generator((1,), 100, Settings(0, 50, 3))
    for k in range(4):
        g.consume(k * 100, (1.0,))
    (s,) = g.snapshot()
    assert (s.start, s.end, s.final) == (0, 300, False) and struct.unpack(">f", s.model)[0] == 1.0


def test_split_and_join():
    ticks = [(k * 100, (10.0, 10.0)) for k in range(30)] + [(k * 100, (float(k * 7 % 11), float(k * 5 % 13) + 90)) for k in range(30, 90)] + [(k * 100, (float(k // 20),) * 2) for k in range(90, 600)]
    out = compress(ticks, (1, 2), 100, Settings(0, 10, 0, 0.9))
    widths = [len(s.members) for s in sorted(out, key=lambda s: s.start)]
    assert 1 in widths and widths[0] == 2 and widths[-1] == 2


@pytest.mark.parametrize("models", [("pmc_mean", "swing_filter", "gorilla"), ("swing_filter", "pmc_mean"), ("gorilla",), (), ("pmc_mean",)])
def test_whole_stretches_give_the_segments_of_single_ticks(models):
    rng = np.random.default_rng(len(models))
    for trial in range(40):
        w, n = int(rng.integers(1, 4)), int(rng.integers(1, 300))
        ts = np.cumsum(np.where(rng.random(n) < 0.03, 300, 100))
        base = [np.cumsum(rng.normal(0, 1, n)), 50 + np.floor(np.arange(n) / 20), np.arange(n) * 1.5, rng.integers(0, 3, n) * 1.0, 100 + rng.normal(0, 0.5, n)][trial % 5]
        v = np.stack([base + rng.normal(0, 0.01, n) * rng.integers(0, 2) for _ in range(w)], 1).astype(np.float32).astype(float)
        v[rng.random(v.shape) < 0.01] = np.nan
        conf, tids = Settings(float([0, 1, 5, 10][trial % 4]), [10, 50][trial % 2], 0, 0.0, models), tuple(range(1, w + 1))
        ticks = [(int(t), tuple(None if np.isnan(x) else float(x) for x in r)) for t, r in zip(ts, v)]
        want = [(s.start, s.end, tuple(s.gaps), tuple(s.members), s.mtid, s.model) for s in compress(ticks, tids, 100, conf)]
        assert [(a, b, g, m, x.mtid, x.model) for a, b, g, m, x in vectorised.compress(ts, v, tids, 100, conf)] == want
