"""Readings of many sources put into order, without any task that holds a whole source.

A source can hold a large share of all rows, so nothing here partitions by source alone. Rows are
placed by (key, time bucket); what a bucket must know of the rows before it comes from one summary
row per bucket, and only those summaries are ordered per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.session import millis

#: Length of a time bucket. A bucket is the largest unit one task must hold of one key.
BUCKET_MS = 2 * 86_400_000


def readings(df: DataFrame, key: str = "tid", ts: str = "timestamp", value: str = "value", bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, b, ts_ms, v): every reading once, hash-placed by (key, b).

    Copies of a (key, timestamp) count once; if they differ, a usable value wins over none and the
    largest usable value over others. ``v`` is null where no copy has a usable value (null or NaN).
    Rows with a null key or timestamp stand nowhere in time and are left out. Other columns of the
    input are ignored, whatever their names.
    """
    v = F.col(value).cast("float")
    rows = df.select(F.col(key).alias(key), millis(ts).alias("ts_ms"), F.when(~F.isnan(v), v).alias("v"))
    rows = rows.where(F.col(key).isNotNull() & F.col("ts_ms").isNotNull())
    rows = rows.withColumn("b", F.floor(F.col("ts_ms") / F.lit(bucket_ms)).cast("int"))
    # one exchange serves the deduplication and every window over (key, b) after it
    return rows.repartition(key, "b").groupBy(key, "b", "ts_ms").agg(F.max("v").alias("v"))


def with_carry(rows: DataFrame, key: str, order: str, carry: list[str]) -> DataFrame:
    """Adds ``pos`` (0-based position within the key) and ``prev_<c>`` for each carried column: the
    value in the row before, across buckets too. ``rows`` has a column ``b`` that grows with ``order``
    and is placed by (key, b)."""
    w = Window.partitionBy(key, "b").orderBy(order)
    per_key = Window.partitionBy(key).orderBy("b")
    what = F.struct(*(carry or [order]))
    inside = rows.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(what).over(w))
    ends = rows.groupBy(key, "b").agg(F.count(F.lit(1)).alias("_c"), F.max_by(what, F.col(order)).alias("_last"))
    ends = ends.select(
        key, "b",
        F.coalesce(F.sum("_c").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag("_last").over(per_key).alias("_before"),
    )
    joined = inside.join(ends, [key, "b"])
    prev = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_p"))
    return joined.select(
        *[joined[c] for c in rows.columns],
        (F.col("_off") + F.col("_n") - 1).alias("pos"),
        *[prev[c].alias(f"prev_{c}") for c in carry],
    )


def running_sums(rows: DataFrame, key: str, order: list, cols: list[str]) -> DataFrame:
    """Replaces each of ``cols`` by its running sum within the key in ``order`` (a list of columns whose
    first grows with ``b``), through sums within buckets and sums of buckets before."""
    w = Window.partitionBy(key, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_key = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select(*[c for c in rows.columns if c not in cols], *[F.sum(c).over(w).alias(c) for c in cols])
    ends = rows.groupBy(key, "b").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    ends = ends.select(key, "b", *[F.coalesce(F.sum(f"_{c}").over(per_key), F.lit(0)).alias(f"_{c}") for c in cols])
    joined = inside.join(ends, [key, "b"])
    return joined.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in cols else joined[c] for c in rows.columns])


#: Rows of a per-source table that are sent to every executor at most (tens of MB).
BROADCAST_ROWS = 500_000


def with_source(rows: DataFrame, per_source: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins a table of one row a source. It is counted first: up to BROADCAST_ROWS it is broadcast, so that a hot source
    isn't shuffled; beyond that the join is left to the planner, which splits skewed partitions."""
    small = per_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(per_source) if small else per_source, key, how)
