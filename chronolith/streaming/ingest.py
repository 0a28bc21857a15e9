"""Ingestion from streams: model fitting as state of each group, temporary segments for what isn't final yet."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.engine import Engine
from chronolith.models.types import user_types
from chronolith.operators.compress import RAW
from chronolith.operators.generator import Generator, Settings, stored, use
from chronolith.operators.readings import with_source
from chronolith.session import millis

COLUMNS = [c.split()[0] for c in RAW.split(", ")]


class GroupFitter:
    """Points of one group in any order within ``delay_ms`` to segments in order of time.

    Points wait until one ``delay_ms`` later has come, then their ticks are consumed; a point not after the last consumed
    tick is late and is dropped and counted. A point of tid null or -1 flushes the group: all that waits is made final.
    """

    def __init__(self, tids: tuple[int, ...], si: int, settings: Settings, delay_ms: int):
        self.g, self.delay, self.late = Generator(tids, si, settings), delay_ms, 0
        self.tids, self.si, self.models = tids, si, settings.models
        self.waiting: dict[int, list] = {}
        self.newest = self.done = None

    def add(self, points: list[tuple[int, int, float]]) -> tuple[list, list]:
        at = {t: k for k, t in enumerate(self.tids)}
        end = False
        for tid, ts, v in points:
            if tid == -1:
                end = True
            elif self.done is not None and ts <= self.done:
                self.late += 1
            elif v == v and tid in at:
                self.waiting.setdefault(ts, [None] * len(at))[at[tid]] = v
                self.newest = ts if self.newest is None else max(self.newest, ts)
        for ts in sorted(self.waiting):
            if not end and ts > self.newest - self.delay:
                break
            self.g.consume(ts, tuple(self.waiting.pop(ts)))
            self.done = ts
        if end:
            self.g.flush()
        final = [s for s in self.g.take() if s.final]
        return final, [] if end else self.g.snapshot()


def fit_stream(points: DataFrame, settings: Settings, delay_ms: int) -> DataFrame:
    """Stored segments, final or temporary, of a stream of (tid, gid, si, tids, ts_ms, value); ``tids`` are the members of the
    row's group."""

    classes = user_types(settings.models)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        swing = use(settings.models, classes)
        gid = int(key[0])
        pdfs = list(pdfs)
        si = int(pdfs[0]["si"].iloc[0])
        fitter = pickle.loads(state.get[0]) if state.exists else GroupFitter(tuple(int(t) for t in pdfs[0]["tids"].iloc[0]), si, settings, delay_ms)
        points = [(-1 if pd.isna(t) else int(t), 0 if pd.isna(ts) else int(ts), float(v) if v is not None else float("nan")) for p in pdfs for t, ts, v in zip(p["tid"], p["ts_ms"], p["value"])]
        final, temporary = fitter.add(points)
        state.update((pickle.dumps(fitter),))
        rows = [stored(gid, si, s, swing) for s in final + temporary]
        # a row without segment tells that the group's temporary segments are outdated
        yield pd.DataFrame(rows or [(gid, *[None] * (len(COLUMNS) - 1))], columns=COLUMNS)

    return points.groupBy("gid").applyInPandasWithState(step, RAW, "fitter binary", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(engine: Engine, points: DataFrame, checkpoint: str, mode: str = "online", delay_ms: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Ingests a stream of (source, timestamp, value). ``mode`` 'online' makes temporary segments queryable, too; 'bulk' stores
    final ones only. Rows of ``end_of_input`` make all that is buffered final.

    Each micro-batch is one folder named by its number, so a batch that is run again after a failure replaces itself.
    """
    meta = engine.store.series().select("source", "tid", "gid", F.col("sampling_interval").alias("si"), "scaling_factor")
    members = meta.groupBy("gid").agg(F.array_sort(F.collect_list("tid")).alias("tids"))  # a row a group
    p = with_source(points, meta.join(members, "gid"), "source")
    p = p.select(F.when(F.col("timestamp").isNull(), F.lit(-1)).otherwise(F.col("tid")).alias("tid"), "gid", "si", "tids", millis("timestamp").alias("ts_ms"), (F.col("value").cast("float") * F.col("scaling_factor")).cast("float").alias("value"))
    fitted = fit_stream(p, engine.settings, delay_ms)
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def publish(batch: DataFrame, number: int) -> None:
        batch = batch.withColumns({c: F.timestamp_millis(c) for c in ("start_time", "end_time")}).persist()
        try:
            # one change: final segments come as the temporary ones they replace go
            temporary = batch.where("is_final is null or not is_final") if mode == "online" else None
            gids = batch.select("gid").distinct()
            if temporary is not None:
                temporary = gids.join(temporary, "gid", "left").select(*batch.columns)
            engine.store.append_segments(batch.where("is_final"), f"{stream}-{number}", temporary)
        finally:
            batch.unpersist()

    return fitted.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def end_of_input(engine: Engine) -> DataFrame:
    """Rows (source, timestamp, value) that make every group's buffered points final when streamed: one for each source,
    without a time."""
    return engine.store.series().select("source", F.lit(None).cast("timestamp").alias("timestamp"), F.lit(None).cast("float").alias("value"))
