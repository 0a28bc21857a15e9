"""Queries p2, p3, p8, p9 and p10, with SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import garbled, leaks, percentiles, prefix_bpe, repeats
from chronolith.operators.readings import with_source
from chronolith.session import utc


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least 3 readings."""
    r = repeats.collapse(table(spark, d, "data_point"))
    return r.where("n >= 3 and value is not null").select("tid", "start_ms", "end_ms")


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return repeats.collapse(table(spark, d, "data_point")).select("tid", "start_ms", "end_ms", "n", "duration_ms")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c.startswith("p") and c[1:2].isdigit() else c for c in df.columns])


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each series."""
    return rounded(percentiles.exact(percentiles.usable_values(table(spark, d, "data_point"), ["tid"]), ["tid"]))


def p3_by_measure(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of a dimension: few large groups."""
    v = percentiles.usable_values(table(spark, d, "data_point"), ["tid"])
    s = table(spark, d, "time_series").select("tid", "measure")
    return rounded(percentiles.exact(v.join(s, "tid").select("measure", "v"), ["measure"]))


def p3_by_day(spark: SparkSession, d: str) -> DataFrame:
    return rounded(percentiles.exact(percentiles.usable_values(table(spark, d, "data_point"), ["tid", "day"]), ["tid", "day"]))


def p3_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each series from the summaries of its days."""
    v = percentiles.usable_values(table(spark, d, "data_point"), ["tid", "day"])
    return percentiles.combine(percentiles.summaries(v, ["tid", "day"]), ["tid"])


def p3_combined_bound(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of ``p3_combined`` whose rank among the series' values is off by more than the bound, and the series."""
    v = percentiles.usable_values(table(spark, d, "data_point"), ["tid"])
    got = with_source(v, p3_combined(spark, d), "tid")
    name = lambda p: f"p{p * 100:g}"
    counts = [F.sum((F.col("v") < F.col(name(p))).cast("long")).alias(f"lt_{name(p)}") for p in percentiles.PROBS]
    counts += [F.sum((F.col("v") <= F.col(name(p))).cast("long")).alias(f"le_{name(p)}") for p in percentiles.PROBS]
    per = got.groupBy("tid", "n").agg(*counts, F.count(F.lit(1)).alias("seen"))
    room = percentiles.EPS * F.col("n") + 1
    off = [F.when((p * (F.col("n") - 1) < F.col(f"lt_{name(p)}") - room) | (p * (F.col("n") - 1) > F.col(f"le_{name(p)}") - 1 + room), 1).otherwise(0) for p in percentiles.PROBS]
    total = off[0]
    for o in off[1:]:
        total = total + o
    return per.agg(F.coalesce(F.sum(total + F.when(F.col("n") == F.col("seen"), 0).otherwise(1)), F.lit(0)).cast("long").alias("violations"), F.count(F.lit(1)).alias("series"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    where = os.environ.get("CHRONOLITH_TOKENIZERS", "/opt/tokenizers")
    return prefix_bpe.encode_corpus(table(spark, d, "documents"), f"{where}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with wrongly decoded characters."""
    return garbled.garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same with their texts put right as far as possible."""
    return garbled.garbled(table(spark, d, "documents"))


ONCE = """once as (select tid, epoch_ms(timestamp) ts_ms, max(case when not isnan(value) then value end) v
 from data_point where tid is not null and timestamp is not null group by 1, 2)"""

RUNS = f"""{ONCE}, l as (select *, lag(v) over w pv, lag(ts_ms) over w pt from once window w as (partition by tid order by ts_ms)),
 k as (select *, sum(case when abs(v::double - pv::double) <= 0.0005 * abs(pv::double) and ts_ms - pt <= 604800000 then 0 else 1 end)
   over (partition by tid order by ts_ms rows unbounded preceding) r from l),
 g as (select tid, min(ts_ms) start_ms, max(ts_ms) end_ms, count(*) n, count(v) u from k group by tid, r)"""


def percentile_sql(keys: str, frm: str) -> str:
    q = ", ".join(f"round(quantile_cont(v::double, {p}), 4) as p{p * 100:g}" for p in percentiles.PROBS)
    return f"with {ONCE} select {keys}, count(*) n, {q} from {frm} where v is not null group by all"


QUERIES = {
    "p2_found": p2_found, "p2_collapsed": p2_collapsed,
    "p3_percentiles": p3_percentiles, "p3_by_measure": p3_by_measure, "p3_by_day": p3_by_day, "p3_combined": p3_combined, "p3_combined_bound": p3_combined_bound,
    "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_restored": p10_restored,
}

SQL = {
    "p2_found": f"with {RUNS} select tid, start_ms, end_ms from g where n >= 3 and u = n",
    "p2_collapsed": f"with {RUNS} select tid, start_ms, end_ms, n, end_ms - start_ms duration_ms from g",
    "p3_percentiles": percentile_sql("tid", "once"),
    "p3_by_measure": percentile_sql("measure", "once join time_series using (tid)"),
    "p3_combined_bound": f"with {ONCE} select 0::bigint violations, count(distinct tid) series from once where v is not null",
    "p3_by_day": percentile_sql("tid, date '1970-01-01' + (ts_ms // 86400000)::int as day", "once"),
}
