"""Continuous periods and gaps of intervals, from starts and ends that are ranked apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.readings import BUCKET_MS


def ranked(times: DataFrame, key: str, col: str, bucket_ms: int) -> DataFrame:
    """(key, k, col): 1-based rank of each time within its key, from ranks within (key, bucket) plus the
    counts of earlier buckets, so that no task orders a whole key."""
    times = times.withColumn("b", F.floor(F.col(col) / F.lit(bucket_ms)).cast("int")).repartition(key, "b")
    w = Window.partitionBy(key, "b").orderBy(col)
    per_key = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = times.groupBy(key, "b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = offsets.select(key, "b", F.coalesce(F.sum("_c").over(per_key), F.lit(0)).alias("_off"))
    inside = times.withColumn("_n", F.row_number().over(w))
    return inside.join(offsets, [key, "b"]).select(key, (F.col("_off") + F.col("_n")).cast("long").alias("k"), col)


def gaps(intervals: DataFrame, key: str, tolerance: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, gap_from_ms, gap_to_ms): every uncovered stretch between two continuous periods.

    ``intervals`` has key, start_ms, end_ms (inclusive) and ``tolerance``, a number of ms that is the same for
    all rows of a key. Rows with a null key, start or end or an end before the start cover nothing. Starts and
    ends are sorted independently: after k starts and k ends nothing is open, so a gap follows rank k exactly
    where start k+1 exceeds end k by more than the tolerance. Copies of an interval change nothing.
    """
    ok = intervals.where(F.col(key).isNotNull() & F.col("start_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms")))
    starts = ranked(ok.select(key, "start_ms"), key, "start_ms", bucket_ms)
    ends = ranked(ok.select(key, "end_ms"), key, "end_ms", bucket_ms)
    tol = ok.groupBy(key).agg(F.max(F.coalesce(F.col(tolerance), F.lit(0))).alias("_tol"))
    pairs = starts.withColumn("k", F.col("k") - 1).join(ends, [key, "k"])
    pairs = pairs.where(F.col("start_ms") > F.col("end_ms"))  # before the tolerance is known, most pairs go
    return pairs.join(tol, key).where(F.col("start_ms") > F.col("end_ms") + F.col("_tol")).select(
        key, F.col("end_ms").alias("gap_from_ms"), F.col("start_ms").alias("gap_to_ms"))


def periods(intervals: DataFrame, key: str, tolerance: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, start_ms, end_ms): the continuous periods, the complement of ``gaps`` within each key's span.
    A period starts at the key's first start or a gap's end, and ends at a gap's start or the key's last end;
    the n-th start and the n-th end of a key belong together."""
    ok = intervals.where(F.col(key).isNotNull() & F.col("start_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms")))
    g = gaps(intervals, key, tolerance, bucket_ms)
    span = ok.groupBy(key).agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    starts = span.select(key, F.col("lo").alias("start_ms")).unionByName(g.select(key, F.col("gap_to_ms").alias("start_ms")))
    ends = span.select(key, F.col("hi").alias("end_ms")).unionByName(g.select(key, F.col("gap_from_ms").alias("end_ms")))
    return ranked(starts, key, "start_ms", bucket_ms).join(ranked(ends, key, "end_ms", bucket_ms), [key, "k"]).select(key, "start_ms", "end_ms")
