"""Queries p1, p4 to p7 over the stored tables, with SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import compaction, grid, intervals, rolling, spikes
from chronolith.session import millis, shared_dir, utc


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{d}/{name}.parquet")


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The rewritten table: every record once, with the number of rows that held it."""
    out = f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}"
    compaction.compact(table(spark, d, "segment"), table(spark, d, "segment_file"), out)
    return compaction.read_compacted(spark, out).select("gid", millis("start_time").alias("start_ms"), millis("end_time").alias("end_ms"), "mtid", F.lower(F.hex("model")).alias("model_hex"), F.lower(F.hex("gaps")).alias("gaps_hex"), "copies")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records stored more than once."""
    return compacted(spark, d).where("copies > 1").drop("model_hex", "copies")


def p1_compacted(spark: SparkSession, d: str) -> DataFrame:
    return compacted(spark, d).drop("copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings."""
    return p4_flags(spark, d).select("tid", "ts_ms")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "data_point"), table(spark, d, "time_series"), table(spark, d, "measure_limit"))


def p4_impossible_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The two kinds that rules define, for comparison with SQL."""
    return p4_flags(spark, d).where("impossible or stuck").select("tid", "ts_ms", "impossible", "stuck")


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling.rolling_totals(table(spark, d, "data_point"))
    return r.select("tid", "day", *[x for w in (7, 30) for x in (F.round(f"sum_{w}", 2).alias(f"sum_{w}"), F.col(f"cnt_{w}"), F.round(f"avg_{w}", 4).alias(f"avg_{w}"))])


def stored_intervals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segment").select("gid", millis("start_time").alias("start_ms"), millis("end_time").alias("end_ms"))
    si = table(spark, d, "time_series").groupBy("gid").agg(F.max("sampling_interval").alias("si"))
    return s.join(si, "gid", "left")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    g = intervals.gaps(stored_intervals(spark, d), "gid", "si")
    return g.where(F.col("gap_to_ms") - F.col("gap_from_ms") <= 30 * 86_400_000)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(stored_intervals(spark, d), "gid", "si")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Missing slots that get a value."""
    r = grid.regular(table(spark, d, "data_point"), table(spark, d, "time_series"), table(spark, d, "segment"), missing_only=True)
    return r.where("status = 'filled' and value is not null").select("tid", "slot_ms")


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    """Slots by series and status, from the whole regular grid."""
    r = grid.regular(table(spark, d, "data_point"), table(spark, d, "time_series"), table(spark, d, "segment"))
    return r.groupBy("tid", "status").agg(F.count(F.lit(1)).alias("slots"), F.min("slot_ms").alias("first_ms"), F.max("slot_ms").alias("last_ms"))


ONCE = """once as (select tid, epoch_ms(timestamp) ts_ms, max(case when not isnan(value) then value end) v
 from data_point where tid is not null and timestamp is not null group by 1, 2)"""

SEGS = """seg as (select s.gid, epoch_ms(start_time) s, epoch_ms(end_time) e, coalesce(si, 0) si from segment s
 left join (select gid, max(sampling_interval) si from time_series group by 1) t on s.gid = t.gid
 where end_time >= start_time and s.gid is not null),
 far as (select *, max(e) over (partition by gid order by s, e rows between unbounded preceding and 1 preceding) pe from seg)"""

SLOTS = f"""{ONCE}, obs as (select o.tid, si, gid, ts_ms // si * si slot, min(ts_ms) t0, max(ts_ms) t1 from once o
  join (select tid, any_value(gid) gid, max(sampling_interval) si from time_series where sampling_interval > 0 group by 1) t on o.tid = t.tid
  where v is not null group by all),
 lagged as (select *, lag(slot) over w ps, lag(t1) over w pt from obs window w as (partition by tid order by slot)),
 missing as (select tid, gid, unnest(generate_series(ps + si, slot - si, si)) slot from lagged where slot - ps > si and t0 - pt <= 2592000000),
 marked as (select m.tid, m.slot, count(s.gid) n, count(case when list_contains(list_transform(range(octet_length(gaps) // 4),
    lambda i: (('0x' || substr(hex(gaps), i * 8 + 1, 8))::bigint)), m.tid) then 1 end) named
  from missing m left join segment s on s.gid = m.gid and epoch_ms(start_time) <= m.slot and epoch_ms(end_time) >= m.slot and end_time >= start_time
  group by 1, 2)"""


def rolling_sql() -> str:
    parts = ", ".join(f"round(coalesce(sum(s) over w{w}, 0), 2) sum_{w}, coalesce(sum(n) over w{w}, 0)::bigint cnt_{w}, round(sum(s) over w{w} / nullif(sum(n) over w{w}, 0), 4) avg_{w}" for w in (7, 30))
    frames = ", ".join(f"w{w} as (partition by tid order by dy rows between {w - 1} preceding and current row)" for w in (7, 30))
    return f"""with {ONCE}, per as (select tid, ts_ms // 86400000 as dy, sum(v::double) s, count(v) n from once group by 1, 2),
 days as (select tid, unnest(generate_series(min(dy), max(dy))) as dy from per group by tid),
 filled as (select d.tid, d.dy, coalesce(s, 0) s, coalesce(n, 0) n from days d left join per p on d.tid = p.tid and d.dy = p.dy)
 select tid, date '1970-01-01' + dy::int as day, {parts} from filled window {frames}"""


QUERIES = {"p1_found": p1_found, "p1_compacted": p1_compacted, "p4_found": p4_found, "p4_flags": p4_flags, "p4_impossible_stuck": p4_impossible_stuck, "p5_rolling": p5_rolling, "p6_found": p6_found, "p6_periods": p6_periods, "p7_found": p7_found, "p7_grid": p7_grid}

SQL = {
    "p1_found": """select gid, epoch_ms(start_time) start_ms, epoch_ms(end_time) end_ms, mtid, lower(hex(coalesce(gaps, ''::blob))) gaps_hex
 from segment group by gid, start_time, end_time, mtid, model, coalesce(gaps, ''::blob) having count(*) > 1""",
    "p1_compacted": """select distinct gid, epoch_ms(start_time) start_ms, epoch_ms(end_time) end_ms, mtid, lower(hex(model)) model_hex, lower(hex(coalesce(gaps, ''::blob))) gaps_hex from segment""",
    "p4_impossible_stuck": f"""with {ONCE}, lim as (select tid, max(low) low, min(high) high from time_series join measure_limit using (measure) group by 1),
 m as (select *, case when v = lag(v) over (partition by tid order by ts_ms) then 0 else 1 end s from once),
 r as (select *, sum(s) over (partition by tid order by ts_ms rows unbounded preceding) run from m),
 l as (select *, count(*) over (partition by tid, run) n from r),
 z as (select tid, n, coalesce(lead(n) over (partition by tid order by n desc), 0) nx from (select distinct tid, n from l where v is not null)),
 least_n as (select tid, min(n) least_n from z where n >= 40 and n >= 4 * nx group by 1),
 f as (select l.tid, ts_ms, coalesce(v < low or v > high, false) impossible, coalesce(n >= least_n, false) stuck from l left join lim on l.tid = lim.tid left join least_n on l.tid = least_n.tid where v is not null)
 select tid, ts_ms, impossible, stuck from f where impossible or stuck""",
    "p5_rolling": rolling_sql(),
    "p6_found": f"with {SEGS} select gid, pe gap_from_ms, s gap_to_ms from far where s > pe + si and s - pe <= 2592000000",
    "p6_periods": f"""with {SEGS}, isl as (select *, sum(case when pe is null or s > pe + si then 1 else 0 end) over (partition by gid order by s, e rows unbounded preceding) k from far)
 select gid, min(s) start_ms, max(e) end_ms from isl group by gid, k""",
    "p7_found": f"with {SLOTS} select tid, slot slot_ms from marked where not (n > 0 and n = named)",
    "p7_grid": f"""with {SLOTS}, u as (select tid, slot, 'observed' status from obs union all select tid, slot, case when n > 0 and n = named then 'declared' else 'filled' end from marked)
 select tid, status, count(*) slots, min(slot) first_ms, max(slot) last_ms from u group by 1, 2""",
}
