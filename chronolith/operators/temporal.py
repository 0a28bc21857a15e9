"""Joins of events by time: as of the latest one before, and of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.readings import BUCKET_MS


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` with the same key at or before its time, however long before;
    null where there is none. Rows of ``right`` of one key and time should agree; of several one is taken. Rows with a null
    key or time on the left stay and get nulls.

    Both sides are put into one sequence per (key, time bucket), where a running last value does the join; what comes from
    earlier buckets is one row a bucket. No pairs are made and no task holds a whole key.
    """
    what = F.struct(*columns)
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    l = left.select(F.col(key).alias("_k"), ms(left_time).alias("_t"), F.struct(*left.columns).alias("_l"))
    r = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), ms(right_time).alias("_t"), what.alias("_r"))
    rows = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    rows = rows.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_ms * 1000))).repartition("_k", "_b")
    inside = Window.partitionBy("_k", "_b").orderBy("_t", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where(F.col("_r").isNotNull() | F.col("_l").isNotNull()).groupBy("_k", "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_e"))
    ends = ends.select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), F.last("_e", True).over(before).alias("_before"))
    joined = rows.withColumn("_in", F.last("_r", True).over(inside)).where(F.col("_l").isNotNull())
    joined = joined.join(ends, (F.col("_k") == F.col("_ek")) & (F.col("_b") == F.col("_eb")), "left")
    got = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_in", "_before"))
    return joined.select("_l.*", *[got[c].alias(c) for c in columns])


def interval_join(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, time: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Every pair of an interval (``start`` and ``end`` inclusive) and a point of the same key in it, with the columns of
    both; names that both have come from the interval. Both sides are placed by (key, time bucket), an interval once for each
    bucket that it touches, so only what is near in time meets. Null keys and times and intervals that end before they start
    give no pairs."""
    bucket = lambda c: F.floor(F.unix_millis(F.col(c).cast("timestamp")) / F.lit(bucket_ms))
    i = intervals.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("_b", bucket(time)).select(F.col(key).alias("_pk"), F.col(time).alias("_pt"), F.col("_b").alias("_pb"), *[c for c in points.columns if c not in intervals.columns and c not in (key,)])
    j = i.join(p, (i[key] == F.col("_pk")) & (i["_b"] == F.col("_pb")) & F.col("_pt").between(i[start], i[end]))
    return j.drop("_b", "_pb", "_pk", "_pt")
