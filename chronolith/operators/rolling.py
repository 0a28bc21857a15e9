"""Totals over trailing days by block decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.session import millis

DAY_MS = 86_400_000


def daily(df: DataFrame, key: str = "tid", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(key, day, s, n): per key and calendar day (UTC, days since 1970) the sum and count of usable values,
    every reading once. Days whose readings are all unusable have n = 0."""
    v = F.col(value).cast("float")
    rows = df.select(F.col(key).alias(key), millis(ts).alias("ts_ms"), F.when(~F.isnan(v), v).alias("v"))
    rows = rows.where(F.col(key).isNotNull() & F.col("ts_ms").isNotNull())
    rows = rows.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS).cast("int"))
    once = rows.repartition(key, "day").groupBy(key, "day", "ts_ms").agg(F.max("v").alias("v"))  # placed for the next step too
    return once.groupBy(key, "day").agg(
        F.coalesce(F.sum(F.col("v").cast("double")), F.lit(0.0)).alias("s"), F.count("v").alias("n"))


def rolling_totals(df: DataFrame, windows: tuple[int, ...] = (7, 30), key: str = "tid", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(key, day date, sum_<w>, cnt_<w>, avg_<w> for each w): for each key and calendar day from its first to its
    last reading, days without a reading included, totals of the usable values of the w days that end there.
    ``sum`` is 0 and ``avg`` null where the period has no usable value. An empty input gives no rows.

    Readings are reduced to one row per (key, day) before anything is ordered per key, so a hot key is as long
    as its calendar. Days are cut into blocks of w days; with P the running total from the block's start and S
    the running total to the block's end, the period ending at day d is P(d) alone on a block's last day, else
    S(d-w+1) of the block before plus P(d).
    """
    per_day = daily(df, key, ts, value)
    span = per_day.groupBy(key).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = span.select(key, "lo", F.explode(F.sequence("lo", "hi")).alias("day"))
    full = days.join(per_day, [key, "day"], "left").select(
        key, "day", (F.col("day") - F.col("lo")).alias("i"),
        F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    ordered = Window.partitionBy(key).orderBy("i")
    full = full.withColumns({f"k{w}": F.floor(F.col("i") / w).cast("int") for w in windows})
    for w in windows:
        # (key, block, i) is the order by (key, i): the windows share one exchange on the key and one sort
        up = Window.partitionBy(key, f"k{w}").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(key, f"k{w}").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
        full = full.withColumns({f"{a}_{d}{w}": F.sum(a).over(x) for a in ("s", "n") for d, x in (("p", up), ("q", down))})
    cols = []
    for w in windows:
        whole = (F.col("i") % w) == w - 1
        s = F.col(f"s_p{w}") + F.when(whole, 0.0).otherwise(F.coalesce(F.lag(f"s_q{w}", w - 1).over(ordered), F.lit(0.0)))
        n = F.col(f"n_p{w}") + F.when(whole, 0).otherwise(F.coalesce(F.lag(f"n_q{w}", w - 1).over(ordered), F.lit(0)))
        cols += [s.alias(f"sum_{w}"), n.cast("long").alias(f"cnt_{w}")]
    out = full.select(key, F.date_from_unix_date("day").alias("day"), *cols)
    return out.select(key, "day", *[x for w in windows for x in (
        F.col(f"sum_{w}"), F.col(f"cnt_{w}"), F.when(F.col(f"cnt_{w}") > 0, F.col(f"sum_{w}") / F.col(f"cnt_{w}")).alias(f"avg_{w}"))])
