"""Calendar fields and pieces of segments that lie in one unit of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's unit, the unit's length in ms at least, and the field of a time in it. Months and hours of
#: the half day count from 0.
LEVELS = {
    "YEAR": ("year", 31_536_000_000, "year({0})"),
    "MONTH": ("month", 2_419_200_000, "month({0}) - 1"),
    "DAY_OF_MONTH": ("day", 82_800_000, "dayofmonth({0})"),
    "AM_PM": ("hour", 3_600_000, "cast(hour({0}) >= 12 as int)"),
    "HOUR": ("hour", 3_600_000, "hour({0}) % 12"),
    "HOUR_OF_DAY": ("hour", 3_600_000, "hour({0})"),
    "MINUTE": ("minute", 60_000, "minute({0})"),
    "SECOND": ("second", 1_000, "second({0})"),
}
FUNCTIONS = ("COUNT", "MIN", "MAX", "SUM", "AVG")


def pieces(x: DataFrame, level: str) -> DataFrame:
    """Rows of (start_time, end_time, si, len) split at the level's boundaries in the session's time zone: adds ``_field``
    and the ticks ``_i0`` to ``_i1`` (inclusive) of each piece. A piece has at least one tick. Where ticks are further apart
    than the unit, each is a piece, so that no row yields more pieces than ticks."""
    unit, ms, field = LEVELS[level]
    start = F.unix_millis("start_time")
    by_unit = F.expr(f"sequence(date_trunc('{unit}', start_time), end_time, interval 1 {unit})")
    by_tick = F.expr("transform(sequence(0, len - 1), i -> timestamp_millis(unix_millis(start_time) + cast(i as bigint) * si))")
    x = x.withColumn("_at", F.explode(F.when(F.col("si") >= ms, by_tick).otherwise(by_unit)))
    coarse = F.col("si") < ms
    nxt = F.unix_millis(F.expr(f"date_trunc('{unit}', _at) + interval 1 {unit}"))
    at = F.unix_millis("_at")
    si = F.col("si").cast("long")
    i0 = F.greatest(F.lit(0).cast("long"), F.ceil((at - start) / si))
    i1 = F.when(coarse, F.least(F.col("len").cast("long") - 1, F.ceil((nxt - start) / si) - 1)).otherwise(i0)
    return x.withColumns({"_field": F.expr(f"cast({field.format('_at')} as int)"), "_i0": i0, "_i1": i1}).where("_i0 <= _i1")


def piece_aggregates(p: DataFrame, values: Column | None) -> DataFrame:
    """Adds ``_len``, ``_min``, ``_max`` and ``_sum`` of each piece: in closed form for constant and linear segments, from
    a slice of the decoded values for others (``values``)."""
    n = F.col("_i1") - F.col("_i0") + 1
    if values is None:
        # both ends as the points themselves are computed, the sum of all ticks between
        at = lambda i: F.col("c0") + F.col("c1") * ((i + F.col("t_off")) * F.col("si").cast("long"))
        a, b = ((at(F.col(c)).cast("float") / F.col("scale")).cast("float") for c in ("_i0", "_i1"))
        exact = F.when(F.col("c1") == 0, F.col("c0").cast("float").cast("double") * n).otherwise((at(F.col("_i0")) + at(F.col("_i1"))) / 2 * n)
        return p.withColumns({"_len": n, "_min": F.least(a, b), "_max": F.greatest(a, b), "_sum": exact / F.col("scale")})
    part = F.slice(values, (F.col("_i0") + 1).cast("int"), n.cast("int"))
    p = p.withColumn("_part", part)
    return p.withColumns({"_len": n, "_min": F.array_min("_part"), "_max": F.array_max("_part"), "_sum": F.aggregate("_part", F.lit(0.0), lambda s, v: s + v)})
