"""Irregular readings onto a regular grid, missing slots filled by a seasonal regression or marked as declared."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.readings import BUCKET_MS, running_sums, with_carry, with_source
from chronolith.session import millis, written

DAY_MS = 86_400_000
#: Periods of the harmonics: a day, half a day, a week.
PERIODS_MS = (DAY_MS, DAY_MS // 2, 7 * DAY_MS)
#: Slots that one row's explode yields at most.
CHUNK = 4096


def features(ms: Column, origin: Column) -> list[Column]:
    """1, trend in days since the key's origin, and a sine and cosine for each period."""
    out = [F.lit(1.0), (ms - origin).cast("double") / DAY_MS]
    for p in PERIODS_MS:
        phase = (ms % p).cast("double") * (2 * math.pi / p)
        out += [F.sin(phase), F.cos(phase)]
    return out


def fit(rows: DataFrame, key: str, ms: str, value: str) -> DataFrame:
    """(key, origin, beta array<double>): least squares of ``value`` on the features, from normal equations that
    are summed by a distributed, map-side combined aggregation; only 8 + 36 numbers of each key are solved.
    Collinear features (a series shorter than a period) are held down by a slight ridge on all but the mean."""
    n = 2 + 2 * len(PERIODS_MS)
    rows = rows.select(key, F.col(ms).alias("_t"), F.col(value).cast("double").alias("_y"))
    # a fixed origin lets one pass suffice: 2015-01-01 is as good as any, as the trend is re-centred when solved
    origin = F.lit(1_420_070_400_000)
    rows = rows.select(key, "_y", *[x.alias(f"x{i}") for i, x in enumerate(features(F.col("_t"), origin))])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(F.col(f"x{i}") * F.col("_y")).alias(f"c{i}") for i in range(n)]
    eq = rows.groupBy(key).agg(*sums)
    eq = eq.select(key, F.array(*[f"a{i}_{j}" for i in range(n) for j in range(i, n)]).alias("a"), F.array(*[f"c{i}" for i in range(n)]).alias("c"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, c: pd.Series) -> pd.Series:
        upper = np.triu_indices(n)
        A = np.zeros((len(a), n, n))
        A[:, upper[0], upper[1]] = np.stack(a.to_list()) if len(a) else np.zeros((0, len(upper[0])))
        A = A + np.triu(A, 1).transpose(0, 2, 1)
        C = np.stack(c.to_list()) if len(c) else np.zeros((0, n))
        # shift the trend to its mean, so that it isn't collinear with the constant
        m = np.divide(A[:, 0, 1], np.maximum(A[:, 0, 0], 1))
        T = np.tile(np.eye(n), (len(a), 1, 1))
        T[:, 1, 0] = -m
        A = T @ A @ T.transpose(0, 2, 1)
        C = np.einsum("kij,kj->ki", T, C)
        ridge = np.einsum("kii->ki", A) * 1e-6 + 1e-9
        ridge[:, 0] = 0
        idx = np.arange(n)
        A[:, idx, idx] += ridge
        ok = np.isfinite(A).all((1, 2)) & np.isfinite(C).all(1)
        A[~ok], C[~ok] = np.eye(n), 0
        B = np.linalg.solve(A, C[:, :, None])[:, :, 0]
        B = np.einsum("kji,kj->ki", T, B)
        return pd.Series(list(B))

    return eq.select(key, origin.alias("origin"), solve("a", "c").alias("beta"))


def predict(ms: Column, origin: Column, beta: Column) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(features(ms, origin)):
        out = out + beta[i] * x
    return out


def gap_members(gaps: Column) -> Column:
    """The tids in a gaps field: big-endian 32-bit integers; a negative one is a temporal offset, not a tid."""
    h = F.hex(gaps)
    parts = F.transform(F.sequence(F.lit(0), (F.octet_length(gaps) / 4).cast("int") - 1), lambda i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    tids = F.filter(parts, lambda t: t < F.lit(1 << 31))
    return F.when(F.octet_length(gaps) >= 4, F.transform(tids, lambda t: t.cast("int"))).otherwise(F.array().cast("array<int>"))


def declared(slots: DataFrame, segments: DataFrame, series: DataFrame, bucket_ms: int) -> DataFrame:
    """``slots`` (tid, slot_ms, ...) with ``declared``: at least one row of ``segments`` of the tid's gid covers the
    slot and every covering row names the tid in its gaps. Openings and closings of segments are swept together
    with the slots in order of time, so no pairs of slots and segments are made."""
    seg = segments.select("gid", F.unix_millis(F.col("start_time").cast("timestamp")).alias("s"), F.unix_millis(F.col("end_time").cast("timestamp")).alias("e"), gap_members(F.col("gaps")).alias("named"))
    seg = seg.where(F.col("gid").isNotNull() & F.col("s").isNotNull() & (F.col("e") >= F.col("s")))
    per_tid = seg.join(series.select("tid", "gid").where(F.col("tid").isNotNull()).distinct(), "gid")
    named = F.array_contains("named", F.col("tid")).cast("long")
    edges = per_tid.select("tid", F.explode(F.array(
        F.struct(F.col("s").alias("at"), F.lit(0).alias("rank"), F.lit(1).cast("long").alias("open"), named.alias("open_named")),
        F.struct(F.col("e").alias("at"), F.lit(2).alias("rank"), F.lit(-1).cast("long").alias("open"), (-named).alias("open_named")),
    )).alias("x")).select("tid", "x.*")
    edges = edges.groupBy("tid", "at", "rank").agg(F.sum("open").alias("open"), F.sum("open_named").alias("open_named"))
    what = F.struct(*[c for c in slots.columns if c != "tid"])
    marks = slots.select("tid", F.col("slot_ms").alias("at"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("open_named"), what.alias("what"))
    swept = edges.withColumn("what", F.lit(None).cast(marks.schema["what"].dataType)).unionByName(marks)
    swept = swept.withColumn("b", F.floor(F.col("at") / F.lit(bucket_ms)).cast("int")).repartition("tid", "b")
    swept = running_sums(swept, "tid", ["at", "rank"], ["open", "open_named"])
    return swept.where("rank = 1").select("tid", "what.*", ((F.col("open") > 0) & (F.col("open") == F.col("open_named"))).alias("declared"))


def regular(df: DataFrame, series: DataFrame, segments: DataFrame, max_gap_ms: int = 30 * DAY_MS, bucket_ms: int = BUCKET_MS, missing_only: bool = False) -> DataFrame:
    """(tid, slot_ms, value double, status): the series on the grid of its sampling_interval.

    A reading belongs to the slot at or before it; a slot with several usable readings gets their mean and status
    'observed'. Between two successive usable readings at most ``max_gap_ms`` apart, every slot without usable
    reading appears: with status 'declared' and no value where the stored segments declare the tid missing there,
    else 'filled' with the regression's prediction plus the residuals at the gap's two ends, interpolated. Longer
    pauses give no slots. A tid that is missing in ``series`` or has a null or non-positive interval has no grid
    and gives no rows. ``missing_only`` leaves out the observed slots.
    """
    step = series.where("tid is not null and sampling_interval > 0").groupBy("tid").agg(F.max("sampling_interval").cast("long").alias("si"))
    v = F.col("value").cast("float")
    rows = df.select("tid", millis("timestamp").alias("ts_ms"), F.when(~F.isnan(v), v).alias("v")).where("tid is not null and ts_ms is not null and v is not null")
    # buckets of whole slots: one exchange serves the copies, the slots and the order of slots
    rows = with_source(rows, step, "tid")
    width = F.col("si") * F.ceil(F.lit(bucket_ms) / F.col("si"))
    rows = rows.withColumn("b", F.floor(F.col("ts_ms") / width).cast("int")).repartition("tid", "b")
    rows = rows.groupBy("tid", "b", "ts_ms", "si").agg(F.max("v").alias("v"))
    at = rows.groupBy("tid", "b", (F.floor(F.col("ts_ms") / F.col("si")) * F.col("si")).alias("slot_ms"), "si").agg(
        F.avg(F.col("v").cast("double")).alias("value"), F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    beta = fit(at, "tid", "slot_ms", "value")
    at = with_carry(at, "tid", "slot_ms", ["slot_ms", "t1", "value"])
    gap = at.where((F.col("slot_ms") - F.col("prev_slot_ms") > F.col("si")) & (F.col("t0") - F.col("prev_t1") <= F.lit(max_gap_ms)))
    gap = gap.join(beta, "tid")
    gap = gap.select(
        "tid", "si", F.col("prev_slot_ms").alias("l"), F.col("slot_ms").alias("r"), "origin", "beta",
        (F.col("prev_value") - predict(F.col("prev_slot_ms"), F.col("origin"), F.col("beta"))).alias("rl"),
        (F.col("value") - predict(F.col("slot_ms"), F.col("origin"), F.col("beta"))).alias("rr"))
    gap = written(gap, "gaps")  # what follows passes over them twice
    gap = gap.withColumn("from", F.explode(F.sequence(F.col("l") + F.col("si"), F.col("r") - F.col("si"), F.col("si") * CHUNK)))
    last = F.least(F.col("from") + F.col("si") * (CHUNK - 1), F.col("r") - F.col("si"))
    gap = gap.withColumn("slot_ms", F.explode(F.sequence(F.col("from"), last, F.col("si"))))
    share = (F.col("slot_ms") - F.col("l")) / (F.col("r") - F.col("l"))
    slots = gap.select("tid", "slot_ms", (predict(F.col("slot_ms"), F.col("origin"), F.col("beta")) + F.col("rl") * (1 - share) + F.col("rr") * share).alias("value"))
    marked = declared(slots, segments, series, bucket_ms)
    missing = marked.select("tid", "slot_ms", F.when(~F.col("declared"), F.col("value")).alias("value"), F.when(F.col("declared"), "declared").otherwise("filled").alias("status"))
    if missing_only:
        return missing
    return at.select("tid", "slot_ms", "value", F.lit("observed").alias("status")).unionByName(missing)
