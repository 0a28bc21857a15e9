"""Data-preparation operators against brute force, with nulls, copies, ties, empty tables and clashing names."""

import json
import os

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from readings_helper import readings_frame

from chronolith.operators import compaction, grid, intervals, rolling, spikes
from chronolith.operators.readings import readings, with_carry
from chronolith.operators.runs import runs

DAY = 86_400_000
NAN = float("nan")


def test_readings_once(spark):
    got = readings(readings_frame(spark, [(1, 5, 1.0), (1, 5, 1.0), (1, 5, None), (1, 6, NAN), (None, 5, 1.0), (1, None, 1.0)]), bucket_ms=10).collect()
    assert {(r["tid"], r["ts_ms"], r["v"]) for r in got} == {(1, 5, 1.0), (1, 6, None)}


def test_carry_crosses_buckets(spark):
    rng = np.random.default_rng(1)
    rows = [(int(t), int(x), float(x)) for t in (1, 2) for x in rng.choice(5000, 300, replace=False)]
    got = with_carry(readings(readings_frame(spark, rows), bucket_ms=37), "tid", "ts_ms", ["ts_ms", "v"]).toPandas()
    for t, g in got.groupby("tid"):
        g = g.sort_values("ts_ms")
        assert g["pos"].tolist() == list(range(300)) and g["prev_ts_ms"].tolist()[1:] == g["ts_ms"].tolist()[:-1]
        assert pd.isna(g["prev_ts_ms"].iloc[0])


@pytest.mark.parametrize("bucket", [7, 100, 10**9])
@pytest.mark.parametrize("rel,gap", [(0, None), (0.01, 25)])
def test_runs_against_loop(spark, bucket, rel, gap):
    rng = np.random.default_rng(3)
    rows = [(t, int(x), [None, NAN, 100.0, 100.0, 100.5, -7.0, 0.0][rng.integers(7)]) for t in (1, 2) for x in np.sort(rng.choice(900, 200, replace=False))]
    got = {(r["tid"], r["start_ms"], r["end_ms"], r["n"]) for r in runs(readings_frame(spark, rows), rel, gap, bucket_ms=bucket).collect()}
    want, cur = set(), None
    for t, x, v in rows:
        ok = v is not None and v == v
        if cur and cur[0] == t and ok and cur[4] is not None and abs(v - cur[4]) <= rel * abs(cur[4]) and (gap is None or x - cur[2] <= gap):
            cur = (t, cur[1], x, cur[3] + 1, v)
        else:
            want |= {cur[:4]} if cur else set()
            cur = (t, x, x, 1, v if ok else None)
    assert got == want | {cur[:4]}
    assert runs(readings_frame(spark, [(1, 1, 1.0)]).where("false")).count() == 0


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(5)
    rows = [(t, int(d * DAY + rng.integers(DAY)), None if rng.random() < 0.2 else float(rng.integers(100))) for t in (1, 2) for d in rng.choice(90, 40)]
    got = rolling.rolling_totals(readings_frame(spark, rows + rows[:9]), (1, 7, 30)).toPandas()
    df = pd.DataFrame(rows, columns=["tid", "ms", "v"]).drop_duplicates()
    for t, g in df.groupby("tid"):
        day = pd.to_datetime(g["ms"], unit="ms").dt.floor("D")
        per = g.groupby(day)["v"].agg(["sum", "count"]).asfreq("D", fill_value=0)
        mine = got[got.tid == t].sort_values("day")
        assert len(mine) == len(per)
        for w in (1, 7, 30):
            assert mine[f"sum_{w}"].tolist() == per["sum"].rolling(w, min_periods=1).sum().tolist()
            assert mine[f"cnt_{w}"].tolist() == per["count"].rolling(w, min_periods=1).sum().astype(int).tolist()
            assert (mine[f"avg_{w}"].isna() == (mine[f"cnt_{w}"] == 0)).all()


@pytest.mark.parametrize("bucket", [5, 10**6])
def test_gaps_and_periods(spark, bucket):
    rng = np.random.default_rng(7)
    rows = [(int(g), int(s), None if rng.random() < 0.05 else int(s + rng.integers(-3, 12)), 4) for g in (1, 2, 3) for s in rng.integers(0, 400, 60)]
    rows += rows[:5] + [(None, 1, 2, 4), (1, None, 2, 4)]
    df = spark.createDataFrame(rows, "gid int, start_ms long, end_ms long, tol int").withColumn("k", F.lit("x"))
    gaps = {tuple(r) for r in intervals.gaps(df, "gid", "tol", bucket).collect()}
    periods = {tuple(r) for r in intervals.periods(df, "gid", "tol", bucket).collect()}
    want_g, want_p = set(), set()
    for g in (1, 2, 3):
        cur = None
        for s, e in sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None and r[2] >= r[1]):
            if cur and s <= cur[1] + 4:
                cur = (cur[0], max(cur[1], e))
            else:
                if cur:
                    want_g.add((g, cur[1], s)), want_p.add((g, *cur))
                cur = (s, e)
        want_p.add((g, *cur))
    assert gaps == want_g and periods == want_p
    assert intervals.gaps(df.where("false"), "gid", "tol").count() == 0


def grid_tables(spark, gaps):
    series = spark.createDataFrame([(1, 9, 10), (2, 9, 10), (3, 8, None)], "tid int, gid int, sampling_interval int")
    seg = spark.createDataFrame(gaps, "gid int, s long, e long, gaps binary").select("gid", F.timestamp_millis("s").alias("start_time"), F.timestamp_millis("e").alias("end_time"), "gaps")
    return series, seg


def test_grid_marks_and_fills(spark):
    t1 = (1).to_bytes(4, "big")
    series, seg = grid_tables(spark, [(9, 20, 40, t1), (9, 50, 60, t1), (9, 60, 60, None), (9, 70, None, t1), (9, 80, 70, t1), (9, 90, 90, t1 + (-5 & 0xFFFFFFFF).to_bytes(4, "big"))])
    rows = [(1, 3, 1.0), (1, 13, 2.0), (1, 13, 2.0), (1, 105, 20.0), (1, 55, NAN), (2, 0, 1.0), (2, 2, 3.0), (2, 31, 4.0), (3, 0, 1.0), (4, 0, 1.0)]
    got = {(r["tid"], r["slot_ms"]): (r["status"], r["value"]) for r in grid.regular(readings_frame(spark, rows), series, seg, bucket_ms=30).collect()}
    want = {**{(1, s): "observed" for s in (0, 10, 100)}, **{(1, s): "declared" for s in (20, 30, 40, 50, 90)}, **{(1, s): "filled" for s in (60, 70, 80)}, (2, 0): "observed", (2, 10): "filled", (2, 20): "filled", (2, 30): "observed"}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[2, 0][1] == 2.0 and 2.0 < got[2, 10][1] < got[2, 20][1] < 4.0 and got[1, 20][1] is None
    assert grid.regular(readings_frame(spark, rows).where("false"), series, seg).count() == 0


def test_long_pauses_stay_empty_and_season_is_followed(spark):
    series = spark.createDataFrame([(1, 9, 3_600_000)], "tid int, gid int, sampling_interval int")
    _, seg = grid_tables(spark, [(9, 1, 0, None)])
    hour = 3_600_000
    rows = [(1, k * hour, float(10 + 5 * np.sin(2 * np.pi * (k % 24) / 24))) for k in range(24 * 10) if not 100 <= k < 112] + [(1, 60 * DAY, 1.0)]
    got = {r["slot_ms"] // hour: r["value"] for r in grid.regular(readings_frame(spark, rows), series, seg, missing_only=True).collect()}
    assert sorted(got) == list(range(100, 112))
    assert max(abs(got[k] - (10 + 5 * np.sin(2 * np.pi * (k % 24) / 24))) for k in got) < 0.5


def segment_frame(spark, rows):
    return spark.createDataFrame(rows, "gid int, s long, e long, mtid int, model binary, gaps binary, file_name string").select(
        "gid", F.timestamp_millis("s").cast("timestamp_ntz").alias("start_time"), F.timestamp_millis("e").cast("timestamp_ntz").alias("end_time"), "mtid", "model", "gaps", "file_name", F.lit(1).alias("copies"))


def test_compaction_keeps_every_record_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(5)), int(rng.integers(50)) * 10, None if rng.random() < 0.1 else 700, 2, bytes(rng.integers(0, 2, 2).tolist()), [None, b"", b"\0\0\0\1"][rng.integers(3)], [None, "a", "b", "c"][rng.integers(4)]) for _ in range(400)]
    rows.append((None, None, None, None, None, None, None))
    df, files = segment_frame(spark, rows), spark.createDataFrame([("a", None), ("b", 10), ("z", 5)], "file_name string, n_bytes long")
    want = {(g, s, e, m, x, y or b"") for g, s, e, m, x, y, _ in rows}
    key = lambda r: (r["gid"], r["start_ms"], r["end_ms"], r["mtid"], r["model"] and bytes(r["model"]), bytes(r["gaps"]))
    got = compaction.resolved(df).collect()
    assert len(got) == len(want) and {key(r) for r in got} == want and sum(r["copies"] for r in got) == len(rows)
    out = str(tmp_path / "out")
    for target in (300, 2000, 1 << 20):
        m = compaction.compact(df, files, out, target)
        assert m["rows"] == len(want) and m["merged_rows"] == len(rows) and len(m["files"]) <= m["loads"]["groups"]
        back = compaction.read_compacted(spark, out)
        assert {key(r) for r in back.select("*", F.unix_millis(F.col("start_time").cast("timestamp")).alias("start_ms"), F.unix_millis(F.col("end_time").cast("timestamp")).alias("end_ms")).collect()} == want and back.count() == len(want)
        for f in m["files"]:
            one = [(r["gid"] is not None, r["gid"] or 0, r["start_time"] is not None, r["start_time"]) for r in pq.read_table(os.path.join(out, f["name"])).to_pylist()]
            assert one == sorted(one, key=lambda x: x[:3] + ((x[3],) if x[3] else ())) and len(one) == f["rows"]
    assert len(compaction.vacuum(spark, out, 0)) > 0 and compaction.read_compacted(spark, out).count() == len(want)
    m = compaction.compact(df.where("false"), files, out)
    assert m["rows"] == 0 and compaction.read_compacted(spark, out).count() == 0 and json.load(open(os.path.join(out, "_manifest.json")))["rows"] == 0


def test_output_files_are_the_balanced_groups(spark, tmp_path):
    """Many small files and one that holds a third of the rows."""
    rows = [(k % 7, k, k + 1, 2, bytes([k % 251]) * 20, None, "hot" if k % 3 == 0 else f"f{k // 9}") for k in range(6000)]
    m = compaction.compact(segment_frame(spark, rows), spark.createDataFrame([("hot", None)], "file_name string, n_bytes long"), str(tmp_path / "o"), 12_000)
    held = [f["rows"] for f in m["files"]]
    assert m["loads"]["largest"] <= 1.2 * m["loads"]["mean"] and len(held) == m["loads"]["groups"] > 20
    assert sum(held) == 6000 and max(held) <= 1.4 * 6000 / len(held)


def test_failed_check_publishes_nothing(spark, tmp_path, monkeypatch):
    df = segment_frame(spark, [(1, 0, 1, 2, b"a", None, "f")])
    monkeypatch.setattr(compaction, "resolved", lambda s: compaction.records(s).where("false").withColumns({"copies": F.lit(1).cast("long"), "file": F.lit(1).cast("long")}))
    with pytest.raises(RuntimeError):
        compaction.compact(df, spark.createDataFrame([], "file_name string, n_bytes long"), str(tmp_path / "o"))
    assert not os.path.exists(tmp_path / "o" / "_manifest.json")


def test_schedule_is_balanced():
    rng = np.random.default_rng(1)
    w = {i: int(x) for i, x in enumerate(rng.integers(1, 100, 500))}
    to = compaction.schedule(w, 7)
    load = [sum(w[i] for i in w if to[i] == g) for g in range(7)]
    assert max(load) - min(load) <= 100 and to == compaction.schedule(w, 7)
    assert compaction.schedule({}, 3) == {}


def judged(spark, rows, block=8192):
    series = spark.createDataFrame([(1, "m"), (2, None)], "tid int, measure string")
    limits = spark.createDataFrame([("m", 0.0, 1000.0)], "measure string, low double, high double")
    return {(r["tid"], r["ts_ms"]): (r["impossible"], r["spike"], r["stuck"]) for r in spikes.implausible(readings_frame(spark, rows), series, limits, block).collect()}


def test_implausible_kinds(spark):
    rng = np.random.default_rng(4)
    v = 100 + rng.normal(0, 1, 600)
    v[300:] += 40  # a lasting change of level
    v[100], v[200:203], v[50], v[400:450] = 130, 70, -5, 141.5
    v[500:512] = 140.25  # an ordinary plateau
    rows = [(1, k * 1000, float(x)) for k, x in enumerate(v)] + [(2, k * 1000, float(x)) for k, x in enumerate(v)]
    rows += rows[95:105] + [(1, 10**7, None), (1, 10**7 + 1, NAN), (3, 5, 1.0)]
    got = judged(spark, rows)
    want = {100: (False, True, False), **{k: (False, True, False) for k in (200, 201, 202)}, **{k: (False, False, True) for k in range(400, 450)}}
    assert {k[1] // 1000: x for k, x in got.items() if k[0] == 1} == {**want, 50: (True, False, False)}
    assert {k[1] // 1000 for k in got if k[0] == 2} == {*want, 50}
    assert judged(spark, [(1, 1, None)]) == {} and judged(spark, [(1, 1, 5.0)]) == {}


def test_blocks_agree_with_one_block(spark):
    rng = np.random.default_rng(8)
    v = 50 + rng.normal(0, 1, 3000)
    at = rng.choice(np.arange(20, 2980, 30), 25, replace=False)
    v[at] += 25
    rows = [(1, k * 1000, float(x)) for k, x in enumerate(v)]
    for block in (8192, 512, 128):
        assert {k[1] // 1000 for k in judged(spark, rows, block)} == set(at.tolist())


def test_stuck_lengths(spark):
    runs = [(1, 0, 400), (1, 1000, 90), (1, 2000, 20), (2, 0, 60), (2, 1000, 16), (3, 0, 39), (4, 0, 50), (4, 1000, 50)]
    rows = [(spikes.STRETCH, t, -1, a, a + n - 1, 1.0, n, False, False, [a], None, None) for t, a, n in runs]
    assert {(r["tid"], r["ts_ms"]) for r in spikes.stuck(spark.createDataFrame(rows, spikes.FOUND)).collect()} == {(1, 0), (1, 1000), (4, 0), (4, 1000)}


def test_stuck_across_blocks(spark):
    rng = np.random.default_rng(6)
    v = 50 + rng.normal(0, 1, 900)
    v[170:430] = 51.5  # spans several blocks of 64
    v[600:640] = 49.5
    rows = [(1, k * 1000, float(x)) for k, x in enumerate(v)]
    for block in (64, 8192):
        assert {k[1] // 1000 for k, x in judged(spark, rows, block).items() if x[2]} == {*range(170, 430), *range(600, 640)}
    rows[300] = (1, 300_000, None)  # an unusable reading ends the stretch: 130 and 129 are both stuck
    assert {k[1] // 1000 for k, x in judged(spark, rows, 64).items() if x[2]} == {*range(170, 300), *range(301, 430), *range(600, 640)}


def test_risk_moves_the_cutoff():
    """Of ordinary readings about the share RISK lies beyond the cutoff."""
    rng = np.random.default_rng(7)
    n = 400_000
    v, ts, block = rng.normal(0, 1, n) + 5 * np.sin(np.arange(n) / 50), np.arange(n) * 60_000, np.arange(n) // 8000
    beyond = {}
    for risk in (1e-2, 1e-3, 1e-4, 1e-9):
        old, spikes.RISK = spikes.RISK, risk
        try:
            beyond[risk] = int(spikes.spikes(block, ts, v)[0].sum())
        finally:
            spikes.RISK = old
    assert n * 1e-2 / 3 < beyond[1e-2] < n * 1e-2 * 3 and n * 1e-3 / 4 < beyond[1e-3] < n * 1e-3 * 4 and beyond[1e-4] < n * 1e-4 * 5 and beyond[1e-9] <= 1


@pytest.mark.parametrize("held", [2, 3])
def test_held_spike_of_a_still_source(held):
    """Farther off than the source's level ever goes: no short plateau, though its readings are equal."""
    rng = np.random.default_rng(2)
    v = np.where(np.arange(140) // 14 % 2, 29.44, 24.22) + rng.choice([0, 0.01], 140)
    v[62 : 62 + held] = 47.7
    assert np.flatnonzero(spikes.spikes(np.zeros(140, np.int64), np.arange(140) * 60_000, v)[0]).tolist() == list(range(62, 62 + held))


def test_implausible_without_rows_limits_or_series(spark):
    rng = np.random.default_rng(5)
    rows = [(7, k * 1000, float(x)) for k, x in enumerate(rng.normal(0, 1, 300))] + [(None, 5, 1.0), (7, None, 1.0), (7, 50_000, None)]
    rows[120] = (7, 120_000, 40.0)
    df = readings_frame(spark, rows)
    series, limits = spark.createDataFrame([(7, "m"), (7, "m"), (None, "m")], "tid int, measure string"), spark.createDataFrame([("m", None, None), (None, 0.0, 1.0)], "measure string, low double, high double")
    for s, l in ((series, limits), (series.where("false"), limits), (series, limits.where("false"))):
        got = spikes.implausible(df, s, l, 100).collect()
        assert [(r["tid"], r["ts_ms"], r["impossible"], r["spike"], r["stuck"]) for r in got] == [(7, 120_000, False, True, False)]
    assert spikes.implausible(df.where("false"), series, limits).count() == 0
