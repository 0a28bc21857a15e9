"""Runs of successive readings that hardly differ, from boundary rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.readings import BUCKET_MS, readings


def alike(pv: Column, v: Column, pt: Column, t: Column, rel: float, max_gap_ms: int | None) -> Column:
    """A usable reading continues the run of the one before it."""
    a, b = pv.cast("double"), v.cast("double")
    same = (a == b) if rel == 0 else (F.abs(b - a) <= F.lit(rel) * F.abs(a))
    if max_gap_ms is not None:
        same = same & ((t - pt) <= F.lit(max_gap_ms))
    return F.coalesce(same, F.lit(False))


def runs(df: DataFrame, rel: float = 0.0005, max_gap_ms: int | None = 7 * 86_400_000, key: str = "tid",
         ts: str = "timestamp", value: str = "value", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, start_ms, end_ms, start_v, end_v, n): every longest stretch of readings in which each is usable
    and differs from the one before by at most ``rel`` times the absolute value of the one before, coming at
    most ``max_gap_ms`` after it. A reading that isn't usable stands alone, with null ``start_v``.

    Within a (key, bucket) only boundary rows are kept: those that differ from their predecessor, and the
    last row. ``lead`` over them gives a run's count (difference of positions) and end (the time before the
    next boundary). Runs that touch an edge of their bucket are then chained per key: at most two a bucket.
    """
    rows = readings(df, key, ts, value, bucket_ms)
    return chain_runs(boundary_runs(rows, key, rel, max_gap_ms), key, rel, max_gap_ms)


def boundary_runs(rows: DataFrame, key: str, rel: float, max_gap_ms: int | None) -> DataFrame:
    w = Window.partitionBy(key, "b").orderBy("ts_ms")
    c = F.col
    rows = rows.select(
        key, "b", "ts_ms", "v",
        F.row_number().over(w).alias("pos"),
        F.lag("ts_ms").over(w).alias("pt"), F.lag("v").over(w).alias("pv"),
        F.lead("ts_ms").over(w).isNull().alias("last"),
    )
    rows = rows.withColumn("starts", ~alike(c("pv"), c("v"), c("pt"), c("ts_ms"), rel, max_gap_ms))
    kept = rows.where(c("starts") | c("last"))
    nxt = F.lead(F.struct("pos", "ts_ms", "v", "pt", "pv", "starts")).over(w)
    kept = kept.withColumn("nx", nxt).where("starts")
    before = c("nx")["starts"]  # the next kept row opens another run; else it is this run's last row
    return kept.select(
        key, "b", c("ts_ms").alias("start_ms"), c("v").alias("start_v"),
        F.when(c("nx").isNull(), c("ts_ms")).when(before, c("nx")["pt"]).otherwise(c("nx")["ts_ms"]).alias("end_ms"),
        F.when(c("nx").isNull(), c("v")).when(before, c("nx")["pv"]).otherwise(c("nx")["v"]).alias("end_v"),
        F.when(c("nx").isNull(), F.lit(1)).when(before, c("nx")["pos"] - c("pos")).otherwise(c("nx")["pos"] - c("pos") + 1).cast("long").alias("n"),
        (c("pos") == 1).alias("at_first"),
        (c("nx").isNull() | ~before).alias("at_last"),
    )


def chain_runs(parts: DataFrame, key: str, rel: float, max_gap_ms: int | None) -> DataFrame:
    c = F.col
    out = [key, "start_ms", "end_ms", "start_v", "end_v", "n"]
    inner = parts.where(~c("at_first") & ~c("at_last")).select(*out)
    w = Window.partitionBy(key).orderBy("start_ms")
    edge = parts.where(c("at_first") | c("at_last"))
    edge = edge.withColumn("p", F.lag(F.struct("end_ms", "end_v", "at_last")).over(w))
    joins = c("at_first") & F.coalesce(c("p")["at_last"], F.lit(False)) & alike(c("p")["end_v"], c("start_v"), c("p")["end_ms"], c("start_ms"), rel, max_gap_ms)
    edge = edge.withColumn("chain", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    edge = edge.groupBy(key, "chain").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min_by("start_v", "start_ms").alias("start_v"), F.max_by("end_v", "end_ms").alias("end_v"), F.sum("n").alias("n"),
    ).select(*out)
    return inner.unionByName(edge)
