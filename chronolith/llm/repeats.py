"""Repeated consecutive events collapsed into one event each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.readings import BUCKET_MS
from chronolith.operators.runs import runs


def collapse(df: DataFrame, rel: float = 0.0005, max_gap_ms: int | None = 7 * 86_400_000, key: str = "tid",
             ts: str = "timestamp", value: str = "value", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, start_ms, end_ms, value float, n, duration_ms): each run of near-identical successive events as one event.

    ``value`` is that of the run's first event and null for an event that isn't usable (null or NaN), which always
    stands alone. Copies of an event count once; events with a null key or time are left out; an empty table gives no
    rows; ``rel`` = 0 collapses equal values only, ``max_gap_ms`` = None joins events however far apart. Rows are
    reduced to those that differ from their predecessor, see ``runs``; neither a long key nor a long run is ever held
    by one task.
    """
    r = runs(df, rel, max_gap_ms, key, ts, value, bucket_ms)
    return r.select(key, "start_ms", "end_ms", F.col("start_v").alias("value"), "n", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
