"""Exact percentiles per group by a distributed sort, and summaries of parts that can be combined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.session import millis, written

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Largest error of a rank from summaries, relative to the group's size.
EPS = 0.005


def usable_values(df: DataFrame, keys: list[str], key: str = "tid", ts: str = "timestamp", value: str = "value") -> DataFrame:
    """(*keys, v double): each usable reading once. ``keys`` may hold ``day`` (UTC) beside ``key``."""
    v = F.col(value).cast("float")
    rows = df.select(F.col(key).alias(key), millis(ts).alias("ts_ms"), F.when(~F.isnan(v), v).alias("v"))
    rows = rows.where(F.col(key).isNotNull() & F.col("ts_ms").isNotNull())
    once = rows.groupBy(key, "ts_ms").agg(F.max("v").alias("v")).where("v is not null")
    day = F.date_from_unix_date(F.floor(F.col("ts_ms") / 86_400_000).cast("int")).alias("day")
    return once.select(*[day if k == "day" else F.col(k) for k in keys], F.col("v").cast("double").alias("v"))


def sorted_counts(values: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(*keys, v, c, lo, n): distinct values of each group with their number ``c``, the number ``lo`` of smaller
    ones and of all ``n``, from one full sort that is written to the shared folder.

    Equal values are counted before the sort, so a group of one repeated value is one row. The sort is by ranges of
    (keys, v): a hot group spreads over as many partitions as its size asks for. Each partition then counts its rows
    of each group; running totals of these small counts over the partitions are the offsets. Nulls in the keys are a
    group of their own. With ``weight`` a row stands for that many values.
    """
    counts = values.groupBy(*keys, "v").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    placed = counts.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    at = written(placed.withColumn("part", F.spark_partition_id()), "sorted")
    per_part = at.groupBy("part", *keys).agg(F.sum("c").alias("_c"))
    # a partition holds a range of (keys, v), so a group has one row here for each partition it touches
    g = Window.partitionBy(*keys)
    before = g.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", *keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(g).alias("n"))
    inside = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    same = [at["part"] == offsets["part"], *[at[k].eqNullSafe(offsets[k]) for k in keys]]
    j = at.join(offsets, same)
    return j.select(*[at[k] for k in keys], "v", "c", (F.col("_in") + F.col("_off")).alias("lo"), "n")


def exact(values: DataFrame, keys: list[str], probs: tuple[float, ...] = PROBS) -> DataFrame:
    """(*keys, n, p<percent> ...): percentiles with linear interpolation between the neighbouring order statistics at
    position p * (n - 1), exact. Groups without values give no row."""
    pos = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)]))
    # of each row only the targets inside its own ranks [lo, lo + c) survive, before anything is moved again
    s = sorted_counts(values, keys)
    s = s.select(*keys, "v", "c", "lo", "n", pos.alias("q"))
    at = F.col("q")["p"] * (F.col("n") - 1)
    holds = lambda k: (k >= F.col("lo")) & (k < F.col("lo") + F.col("c"))
    s = s.where(holds(F.floor(at)) | holds(F.ceil(at)))
    s = s.withColumns({"a": F.when(holds(F.floor(at)), F.col("v")), "z": F.when(holds(F.ceil(at)), F.col("v"))})
    s = s.withColumn("f", at - F.floor(at))
    s = s.groupBy(*keys, "n", F.col("q")["i"].alias("i")).agg(F.max("a").alias("a"), F.max("z").alias("z"), F.max("f").alias("f"))
    s = s.withColumn("x", F.when(F.col("f") == 0, F.col("a")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * F.col("f")))
    return s.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(probs)])


def summaries(values: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """(*keys, n, marks array<struct<v, w>>): of each part's sorted values every step-th, with step = max(1, floor(2 eps n)),
    each standing for the ``w`` values around it. Any rank read from the marks is off by at most eps * n; parts of fewer
    than 1 / eps values are kept whole. Combine with ``combine``: errors of parts add, so the bound stays eps of the total.
    An array holds at most about 1 / eps marks."""
    s = sorted_counts(values, keys)
    step = F.greatest(F.lit(1), F.floor(F.lit(2 * eps) * F.col("n"))).cast("long")
    # blocks of `step` ranks; the middle rank of a block stands for it
    first = F.floor(F.col("lo") / step)
    last = F.floor((F.col("lo") + F.col("c") - 1) / step)
    s = s.withColumn("step", step).withColumn("blk", F.explode(F.sequence(first, last)))
    end = F.least((F.col("blk") + 1) * F.col("step"), F.col("n"))
    mid = F.floor((F.col("blk") * F.col("step") + end - 1) / 2)
    s = s.where((mid >= F.col("lo")) & (mid < F.col("lo") + F.col("c")))
    s = s.select(*keys, "n", "v", (end - F.col("blk") * F.col("step")).alias("w"))
    return s.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("marks"))


def combine(parts: DataFrame, keys: list[str], probs: tuple[float, ...] = PROBS) -> DataFrame:
    """(*keys, n, p<percent> ...): percentiles of the union of all parts of each group from their summaries. The rank of
    each result is within eps of the asked one, relative to the group's n. Marks are counted per value and
    ranked over (keys, v) by the same distributed sort as raw values."""
    m = parts.select(*keys, F.explode("marks").alias("m")).select(*keys, F.col("m.v").alias("v"), F.col("m.w").alias("w"))
    s = sorted_counts(m, keys, "w")
    holds = lambda p: (F.col("lo") <= F.floor(F.lit(p) * (F.col("n") - 1))) & (F.floor(F.lit(p) * (F.col("n") - 1)) < F.col("lo") + F.col("c"))
    hit = None
    for p in probs:
        hit = holds(p) if hit is None else hit | holds(p)
    # of each group only the marks that hold a target go on
    return s.where(hit).groupBy(*keys, "n").agg(*[F.max(F.when(holds(p), F.col("v"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in probs])
