import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import percentiles, repeats


def frame(spark, rows):
    df = spark.createDataFrame(rows, "tid int, ms long, value float")
    return df.select("tid", F.timestamp_millis("ms").alias("timestamp"), "value", F.lit(1).alias("n"), F.lit(2).alias("part"))


def test_collapse(spark):
    rows = [(1, 0, 1.0), (1, 10, 1.0004), (1, 20, 1.0), (1, 30, None), (1, 40, 1.0), (1, 40, 1.0), (2, 0, 0.0), (2, 5, 0.0), (2, 700_000_000, 0.0), (None, 1, 1.0), (1, None, 1.0)]
    got = {(r["tid"], r["start_ms"], r["end_ms"], r["value"], r["n"], r["duration_ms"]) for r in repeats.collapse(frame(spark, rows), bucket_ms=15).collect()}
    assert got == {(1, 0, 20, 1.0, 3, 20), (1, 30, 30, None, 1, 0), (1, 40, 40, 1.0, 1, 0), (2, 0, 5, 0.0, 2, 5), (2, 700_000_000, 700_000_000, 0.0, 1, 0)}
    assert repeats.collapse(frame(spark, rows).where("false")).count() == 0


def test_one_long_run_in_many_buckets(spark):
    rows = [(1, k, 5.0) for k in range(500)]
    (r,) = repeats.collapse(frame(spark, rows), bucket_ms=7).collect()
    assert (r["start_ms"], r["end_ms"], r["n"]) == (0, 499, 500)


@pytest.mark.parametrize("size", [1, 2, 7, 400])
def test_exact_percentiles(spark, size):
    rng = np.random.default_rng(size)
    v = rng.choice(np.float32([0.5, -3, 7.25, 1e6, -1e-3, 2]), size) if size % 2 else rng.normal(0, 5, size).astype(np.float32)
    rows = [(1, k, float(x)) for k, x in enumerate(v)] + [(2, k, 4.0) for k in range(50)] + [(3, 1, None), (3, 2, float("nan")), (1, 0, float(v[0]))]
    got = {r["tid"]: r for r in percentiles.exact(percentiles.usable_values(frame(spark, rows), ["tid"]), ["tid"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert set(got) == {1, 2} and got[1]["n"] == size
    for p, c in ((0, "p0"), (25, "p25"), (50, "p50"), (90, "p90"), (100, "p100")):
        assert abs(got[1][c] - np.percentile(v.astype(float), p)) <= 1e-9 * max(1, np.abs(v).max()) and got[2][c] == 4.0


def test_null_group_is_one(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"]) for r in percentiles.exact(df, ["k"], (0.5,)).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_combined_within_bound(spark):
    rng = np.random.default_rng(0)
    day = 86_400_000
    rows = [(1, int(d * day + k), float(x)) for d in range(5) for k, x in enumerate(rng.lognormal(d, 1, 700))]
    rows += [(2, k, 1.0) for k in range(30)]
    eps = 0.01
    parts = percentiles.summaries(percentiles.usable_values(frame(spark, rows), ["tid", "day"]), ["tid", "day"], eps)
    assert parts.agg(F.max(F.size("marks"))).first()[0] <= 1 / eps
    assert {r["tid"]: r["w"] for r in parts.select("tid", F.explode("marks").alias("m")).groupBy("tid").agg(F.sum("m.w").alias("w")).collect()} == {1: 3500, 2: 30}
    got = {r["tid"]: r for r in percentiles.combine(parts, ["tid"]).collect()}
    v = np.sort(np.float32([x for t, _, x in rows if t == 1]))
    for p in percentiles.PROBS:
        x = got[1][f"p{p * 100:g}"]
        lo, hi = np.searchsorted(v, np.float32(x), "left"), np.searchsorted(v, np.float32(x), "right")
        target = p * (len(v) - 1)
        assert lo - eps * len(v) - 1 <= target <= hi + eps * len(v) + 1
    assert got[2]["p50"] == 1.0
    assert percentiles.exact(percentiles.usable_values(frame(spark, rows).where("false"), ["tid"]), ["tid"]).count() == 0
