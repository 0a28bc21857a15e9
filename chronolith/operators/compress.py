"""Groups of aligned series to stored segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.models.types import user_types
from chronolith.operators import vectorised
from chronolith.operators.generator import Settings, compress, pack_gaps, stored, use
from chronolith.operators.readings import BROADCAST_ROWS
from chronolith.session import millis

STATS = "array<struct<tid:int,low:float,high:float,total:double>>"
STORED = f"gid int, start_time timestamp, end_time timestamp, mtid int, model binary, gaps binary, si int, gap_tids array<int>, members array<int>, t_off int, c0 double, c1 double, stats {STATS}, is_final boolean"
RAW = STORED.replace("timestamp", "long")
#: Ticks of a group in one task. Groups are cut there, so that a long group is fitted by many tasks.
CHUNK_TICKS = 100_000


def align(points: DataFrame, mode: str = "strict") -> DataFrame:
    """(tid, gid, si, ts_ms, value): points on their group's grid. 'strict' fails on a point off the grid that the
    group's interval spans from its first point on; 'floor' moves it to the slot before on the grid from 1970 on and keeps
    the latest of a slot. Points with a null time or unusable value are gaps."""
    v = F.col("value").cast("float")
    p = points.select("tid", "gid", "si", "scaling_factor", millis("timestamp").alias("ts_ms"), v.alias("v")).where("ts_ms is not null and v is not null and not isnan(v)")
    value = (F.col("v") * F.col("scaling_factor")).cast("float")
    slot = F.floor(F.col("ts_ms") / F.col("si")) * F.col("si")
    if mode == "strict":
        off = F.raise_error(F.concat(F.lit("off the grid: tid "), F.col("tid").cast("string"), F.lit(" at "), F.col("ts_ms").cast("string")))
        first = p.groupBy("gid").agg(F.min("ts_ms").alias("first"))  # a row a group
        p = p.join(first, "gid")
        slot = F.when((F.col("ts_ms") - F.col("first")) % F.col("si") == 0, F.col("ts_ms")).otherwise(off.cast("long"))
        return p.select("tid", "gid", "si", slot.alias("ts_ms"), value.alias("value"))
    return p.groupBy("tid", "gid", "si", slot.alias("ts_ms")).agg(F.max_by(value, F.col("ts_ms")).alias("value"))


def encode(points: DataFrame, settings: Settings, groups: DataFrame | None = None, chunk_ticks: int = CHUNK_TICKS) -> DataFrame:
    """Stored segments of aligned points (tid, gid, si, ts_ms, value). ``groups`` (gid, tids) has the members of each group in
    order, by default those in ``points``; a (tid, ts_ms) that stands twice counts once. Members are sent to the workers once,
    as long as the groups are as few as a broadcast allows, else with each row."""

    classes = user_types(settings.models)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        swing = use(settings.models, classes)
        gid, si = int(pdf["gid"].iloc[0]), int(pdf["si"].iloc[0])
        group = tuple(int(t) for t in (members.value[gid] if members else pdf["tids"].iloc[0]))
        at = {t: k for k, t in enumerate(group)}
        ticks: dict[int, list] = {}
        for tid, ts, v in zip(pdf["tid"].tolist(), pdf["ts_ms"].tolist(), pdf["value"].tolist()):
            ticks.setdefault(ts, [None] * len(group))[at[tid]] = v
        rows = [stored(gid, si, s, swing) for s in compress([(ts, tuple(ticks[ts])) for ts in sorted(ticks)], group, si, settings) if s.final]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    def fit_fast(t: pa.Table) -> pa.Table:
        gid, si = t["gid"][0].as_py(), t["si"][0].as_py()
        group = np.array(members.value[gid] if members else t["tids"][0].as_py())
        when, tick = np.unique(t["ts_ms"].to_numpy(), return_inverse=True)
        v = np.full((len(when), len(group)), np.nan)
        v[tick, np.searchsorted(group, t["tid"].to_numpy())] = t["value"].to_numpy()
        made = vectorised.compress(when, v, tuple(group.tolist()), si, settings)
        n = len(made)
        stats = pa.StructArray.from_arrays([pa.array([x for r in made for x in r[3]], pa.int32()), *(pa.array(np.concatenate([getattr(r[4], c) for r in made]) if made else np.zeros(0), k) for c, k in (("low", pa.float32()), ("high", pa.float32()), ("total", pa.float64())))], names=["tid", "low", "high", "total"])
        edges = pa.array(np.r_[0, np.cumsum([len(r[3]) for r in made])].astype(np.int32), pa.int32())
        ints = lambda k: pa.array([list(r[k]) for r in made], pa.list_(pa.int32()))
        of = lambda c, k: pa.array([getattr(r[4], c) for r in made], k)
        cols = [
            pa.array([gid] * n, pa.int32()), pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], pa.int64()), of("mtid", pa.int32()), of("model", pa.binary()),
            pa.array([pack_gaps(r[2]) for r in made], pa.binary()), pa.array([si] * n, pa.int32()), ints(2), ints(3), pa.array([0] * n, pa.int32()), of("c0", pa.float64()), of("c1", pa.float64()),
            pa.ListArray.from_arrays(edges, stats), pa.array([True] * n)]
        return pa.table(cols, names=[c.split()[0] for c in RAW.split(", ")])

    if groups is None:
        groups = points.groupBy("gid").agg(F.array_sort(F.collect_set("tid")).alias("tids"))
    chunk = F.floor(F.col("ts_ms") / (F.col("si").cast("long") * chunk_ticks))
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    members = points.sparkSession.sparkContext.broadcast({r["gid"]: r["tids"] for r in groups.toLocalIterator()}) if few else None
    rows = (points if few else points.join(groups, "gid")).withColumn("chunk", chunk).groupBy("gid", "chunk")
    made = rows.applyInArrow(fit_fast, RAW) if vectorised.applies(settings) else rows.applyInPandas(fit, RAW)
    return made.withColumns({c: F.timestamp_millis(c) for c in ("start_time", "end_time")})


def decode_arrays(segments: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Adds ``_values``: the values of the exploded row's member over the whole stored segment. Reads gid columns of
    the view: mtid, model, k (place among the members), n (members), len, t_off, si."""

    classes = user_types(models)

    @F.pandas_udf("array<float>")
    def values(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        use(models, classes)
        from chronolith.operators.generator import DECODERS

        for mtid, model, k, n, ticks, off, si in batches:
            yield pd.Series([DECODERS[m](b, o + t, w, s)[o:, j] for m, b, j, w, t, o, s in zip(mtid, model, k, n, ticks, off, si)], dtype=object)

    return segments.withColumn("_values", values("mtid", "model", "k", "n", "len", "t_off", "si"))
