"""Queries over the engine's views on series made of the relational test tables, with SQL over the raw rows.

Each series set is compressed once a session and folder. Values are small integers, exact in float32, so that results at
error bound 0 equal those of the raw rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.engine import Engine
from chronolith.functions.calendar import FUNCTIONS, LEVELS
from chronolith.operators import temporal
from chronolith.operators.generator import Settings
from chronolith.plans import rewrite
from chronolith.plans.grouping import Dimension, Dimensions, parse_clause
from chronolith.session import shared_dir, utc
from chronolith.sources.storage import Store
from chronolith.streaming import ingest, transfer

DAY, HOUR = 86_400_000, 3_600_000
EVENT = [Dimension("Event", [("event_type", "text")])]
#: Series sets: tables, the raw rows (source, timestamp, value, dimensions), interval and dimensions.
SETS = {
    "li_daily": (["lineitem"], "select concat(l_returnflag, '_', l_linestatus) source, l_shipdate as timestamp, cast(sum(l_quantity) as float) as value, l_returnflag returnflag, l_linestatus linestatus from lineitem group by all", DAY,
                 [Dimension("Item", [("returnflag", "text"), ("linestatus", "text")])]),
    "ev_hourly": (["events"], "select event_type source, date_trunc('hour', ts) as timestamp, cast(count(*) as float) as value, event_type from events group by all", HOUR, EVENT),
    "ord_weekly": (["orders", "customer", "nation", "region"], """select n_name source, timestamp '1995-01-01 00:00:00' + floor(datediff_days / 7) * interval '7' day as timestamp, cast(count(*) as float) as value, r_name region, n_name nation
  from (select o_custkey, DATEDIFF_DAYS datediff_days from orders) o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""", 7 * DAY,
                   [Dimension("Location", [("region", "text"), ("nation", "text")])]),
    "ev_minute": (["events"], "select event_type source, date_trunc('minute', ts) as timestamp, cast(count(*) as float) as value, event_type from events group by all", 60_000, EVENT),
    "ev_second": (["events"], "select event_type source, date_trunc('second', ts) as timestamp, cast(count(*) as float) as value, event_type from events group by all", 1_000, EVENT),
}
#: Whole days since 1995-01-01 in each dialect.
DAYS = {"spark": "datediff(o_orderdate, date '1995-01-01')", "duck": "datediff('day', date '1995-01-01', o_orderdate::date)"}
TABLES = {t for tables, _, _, _ in SETS.values() for t in tables}
_engines: dict[tuple, Engine] = {}


def register(spark: SparkSession, d: str, tables: Iterable[str]) -> None:
    """Views of the folder's tables, in place of those of another folder."""
    for t in tables:
        df = utc(spark).read.parquet(f"{d}/{t}.parquet")
        df.select(*[F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in df.dtypes]).createOrReplaceTempView(t)


def named(query: str) -> set[str]:
    """The test tables that stand in a query beside the engine's views; a column of such a name after a comma counts, too."""
    ts = rewrite.tokens(query)
    return TABLES & {t.text.lower() for n, t in enumerate(ts) if t.kind == "word" and rewrite.after(ts, n)}


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    tables, sql, _, _ = SETS[name]
    register(spark, d, tables)
    return spark.sql(sql.replace("DATEDIFF_DAYS", DAYS["spark"]))


def engine(spark: SparkSession, d: str, name: str, clause: str = "", derived: tuple = (), store: str = "parquet", **settings) -> Engine:
    """The set, compressed with these settings and correlation clause, in a store of this format."""
    key = (spark.sparkContext.applicationId, d, name, clause, derived, store, tuple(sorted(settings.items())))
    if key not in _engines:
        points = raw(spark, d, name)
        _, _, si, dims = SETS[name]
        # a row for each series; the series set is metadata
        cols = [n for x in dims for n, _ in x.levels]
        meta = points.select("source", *cols).distinct().orderBy("source").collect()
        dimensions = Dimensions(dims)
        for r in meta:
            dimensions.add(r["source"], [r[c] for c in cols])
        e = Engine(spark, Store(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", store), Settings(**settings), [(p, x, dict(m)) for p, x, m in derived])
        e.register({r["source"]: si for r in meta}, dimensions, [parse_clause(clause, dimensions)] if clause else [])
        e.ingest(points.select("source", "timestamp", "value"))
        _engines[key] = e
    return _engines[key]


def duck(name: str) -> str:
    """CTE p(tid, timestamp, value, dimensions...) of the raw rows."""
    return f"p as (select dense_rank() over (order by source)::int tid, * exclude (source) from ({SETS[name][1].replace('DATEDIFF_DAYS', DAYS['duck'])}))"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, data: str, query: str | Callable[[Engine], DataFrame], oracle: str | None, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = engine(spark, d, data, **options)
        if isinstance(query, str):
            register(e.spark, d, named(query))
        return e.sql(query) if isinstance(query, str) else query(e)

    QUERIES[name] = run
    if oracle:
        more = oracle.upper().startswith("WITH ")  # a query with names of its own
        SQL[name] = f"with {duck(data)}, {oracle[5:]}" if more else f"with {duck(data)} {oracle}"


DUCK_AGG = {"COUNT": "count(*)", "MIN": "min(value)", "MAX": "max(value)", "SUM": "sum(value::double)", "AVG": "round(avg(value::double), 6)"}


def shown(f: str, c: str) -> str:
    return f"round({c}, 6)" if f == "AVG" else c


for f in FUNCTIONS:
    low = f.lower()
    add(f"seg_{low}_s", "li_daily", f"SELECT tid, {shown(f, f'{f}_S(#)')} AS v FROM Segment GROUP BY tid", f"select tid, {DUCK_AGG[f]} v from p group by tid")
    add(f"seg_{low}_s_total", "ord_weekly", f"SELECT {shown(f, f'{f}_S(#)')} AS v FROM Segment", f"select {DUCK_AGG[f]} v from p")
DUCK_FIELD = {"YEAR": "year(timestamp)", "MONTH": "month(timestamp) - 1", "DAY_OF_MONTH": "day(timestamp)", "AM_PM": "(hour(timestamp) >= 12)::int", "HOUR": "hour(timestamp) % 12", "HOUR_OF_DAY": "hour(timestamp)", "MINUTE": "minute(timestamp)", "SECOND": "second(timestamp)"}
OF_LEVEL = {"YEAR": "li_daily", "MONTH": "li_daily", "DAY_OF_MONTH": "ord_weekly", "AM_PM": "ev_hourly", "HOUR": "ev_hourly", "HOUR_OF_DAY": "ev_hourly", "MINUTE": "ev_minute", "SECOND": "ev_second"}
for f in FUNCTIONS:
    for level in LEVELS:
        # maps are compared as rows
        add(f"cube_{f.lower()}_{level.lower()}", OF_LEVEL[level],
            lambda e, f=f, level=level: e.sql(f"SELECT tid, {f}_{level}(#) AS m FROM Segment GROUP BY tid").select("tid", F.explode("m").alias("field", "v")).withColumn("v", F.round("v", 6) if f == "AVG" else F.col("v")),
            f"select tid, {DUCK_FIELD[level]} as field, {DUCK_AGG[f]} v from p group by 1, 2")

T0, T1 = "1996-01-01 00:00:00", "1997-06-30 00:00:00"
add("seg_agg_by_dimension", "li_daily", "SELECT returnflag, SUM_S(#) AS s, COUNT_S(#) AS n FROM Segment GROUP BY returnflag", "select returnflag, sum(value::double) s, count(*) n from p group by 1")
add("seg_agg_having", "ord_weekly", "SELECT tid, MAX_S(#) AS m FROM Segment GROUP BY tid HAVING SUM_S(#) > 100", "select tid, max(value) m from p group by 1 having sum(value) > 100")
add("seg_agg_join_table", "ord_weekly", "SELECT n_regionkey, SUM_S(#) AS s FROM Segment JOIN nation ON nation = n_name GROUP BY n_regionkey", "select n_regionkey, sum(value::double) s from p join nation on p.nation = n_name group by 1")
add("seg_start_count", "li_daily", f"SELECT x.tid, COUNT_S(x.tid, x.start_time, x.end_time) AS n FROM (SELECT inline(START(#, TIMESTAMP '{T0}')) FROM Segment WHERE end_time >= TIMESTAMP '{T0}') x GROUP BY x.tid", f"select tid, count(*) n from p where timestamp >= '{T0}' group by 1")
add("seg_end_count", "li_daily", f"SELECT x.tid, COUNT_S(x.tid, x.start_time, x.end_time) AS n FROM (SELECT inline(END(#, TIMESTAMP '{T1}')) FROM Segment WHERE start_time <= TIMESTAMP '{T1}') x GROUP BY x.tid", f"select tid, count(*) n from p where timestamp <= '{T1}' group by 1")
add("seg_start_end_sum", "li_daily", f"SELECT x.tid, SUM_S(x.tid, x.start_time, x.end_time, x.mtid, x.model, x.offsets) AS s FROM (SELECT inline(START_END(#, TIMESTAMP '{T0}', TIMESTAMP '{T1}')) FROM Segment WHERE end_time >= TIMESTAMP '{T0}' AND start_time <= TIMESTAMP '{T1}') x GROUP BY x.tid", f"select tid, sum(value::double) s from p where timestamp between '{T0}' and '{T1}' group by 1")
add("cube_two_levels", "li_daily", lambda e: e.sql("SELECT returnflag, SUM_YEAR(#) AS y, COUNT_MONTH(#) AS m FROM Segment WHERE tid > 1 GROUP BY returnflag").select("returnflag", F.aggregate(F.map_values("y"), F.lit(0.0), lambda a, b: a + b).alias("s"), F.size("m").alias("months")),
    "select returnflag, sum(value::double) s, count(distinct month(timestamp))::int as months from p where tid > 1 group by 1")

PLAIN = {
    "dp_scan": ("li_daily", "SELECT tid, timestamp, value FROM DataPoint"),
    "dp_count_star": ("li_daily", "SELECT count(*) AS n FROM DataPoint"),
    "dp_project_dims": ("ord_weekly", "SELECT tid, region, nation, count(*) AS n FROM DataPoint GROUP BY ALL"),
    "dp_filter_tid_eq": ("li_daily", "SELECT timestamp, value FROM DataPoint WHERE tid = 2"),
    "dp_filter_tid_in": ("li_daily", "SELECT tid, sum(value) AS s FROM DataPoint WHERE tid IN (1, 3, 99) GROUP BY tid"),
    "dp_filter_tid_range": ("ord_weekly", "SELECT tid, sum(value) AS s FROM DataPoint WHERE tid > 20 GROUP BY tid"),
    "dp_filter_time_range": ("li_daily", f"SELECT tid, timestamp, value FROM DataPoint WHERE timestamp >= TIMESTAMP '{T0}' AND timestamp < TIMESTAMP '1996-03-01 00:00:00'"),
    "dp_filter_time_eq": ("li_daily", f"SELECT tid, value FROM DataPoint WHERE timestamp = TIMESTAMP '{T0}'"),
    "dp_filter_member": ("ord_weekly", "SELECT tid, timestamp, value FROM DataPoint WHERE region = 'ASIA'"),
    "dp_filter_value": ("li_daily", "SELECT tid, timestamp FROM DataPoint WHERE value = 25"),
    "dp_case_like": ("ord_weekly", "SELECT CASE WHEN nation LIKE 'A%' THEN 'a' WHEN nation LIKE '%A' THEN 'z' ELSE 'o' END AS k, count(*) AS n FROM DataPoint GROUP BY 1"),
    "dp_gap_detection": ("ev_hourly", "SELECT tid, timestamp, before FROM (SELECT tid, timestamp, lag(timestamp) OVER (PARTITION BY tid ORDER BY timestamp) AS before FROM DataPoint) q WHERE timestamp > before + INTERVAL '1' HOUR"),
    "dp_moving_avg": ("li_daily", "SELECT tid, timestamp, round(avg(value) OVER (PARTITION BY tid ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS m FROM DataPoint"),
    "dp_rank": ("ord_weekly", "SELECT tid, timestamp, rank() OVER (PARTITION BY tid ORDER BY value DESC) AS r, dense_rank() OVER (PARTITION BY tid ORDER BY value DESC) AS d FROM DataPoint"),
    "dp_row_number_ntile": ("ord_weekly", "SELECT tid, timestamp, row_number() OVER (PARTITION BY tid ORDER BY timestamp) AS n, ntile(4) OVER (PARTITION BY tid ORDER BY timestamp) AS q FROM DataPoint"),
    "dp_running_sum": ("li_daily", "SELECT tid, timestamp, sum(value) OVER (PARTITION BY tid ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS s FROM DataPoint"),
    "dp_first_last": ("ev_hourly", "SELECT DISTINCT tid, first_value(value) OVER w AS a, last_value(value) OVER w AS z FROM DataPoint WINDOW w AS (PARTITION BY tid ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "dp_join_inner": ("ord_weekly", "SELECT n_nationkey, sum(value) AS s FROM DataPoint d JOIN nation n ON d.nation = n.n_name GROUP BY n_nationkey"),
    "dp_join_left": ("ord_weekly", "SELECT n_name, count(d.tid) AS n FROM nation n LEFT JOIN DataPoint d ON d.nation = n.n_name AND d.value > 3 GROUP BY n_name"),
    "dp_join_right": ("ord_weekly", "SELECT n_name, count(d.tid) AS n FROM DataPoint d RIGHT JOIN nation n ON d.nation = n.n_name AND d.value > 4 GROUP BY n_name"),
    "dp_join_full": ("ord_weekly", "SELECT count(d.tid) AS a, count(n_name) AS b FROM DataPoint d FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON d.nation = n.n_name"),
    "dp_join_semi": ("ord_weekly", "SELECT tid, count(*) AS n FROM DataPoint d WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = d.nation AND n_regionkey = 1) GROUP BY tid"),
    "dp_join_anti": ("ord_weekly", "SELECT tid, count(*) AS n FROM DataPoint d WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = d.nation AND n_regionkey = 1) GROUP BY tid"),
    "dp_join_cross": ("li_daily", "SELECT r_name, max(m) AS m FROM (SELECT tid, max(value) AS m FROM DataPoint GROUP BY tid) q CROSS JOIN region GROUP BY r_name"),
    "dp_grouping_sets": ("ord_weekly", "SELECT region, year(timestamp) AS y, sum(value) AS s FROM DataPoint GROUP BY GROUPING SETS ((region), (year(timestamp)), ())"),
    "dp_rollup": ("ord_weekly", "SELECT region, nation, sum(value) AS s FROM DataPoint GROUP BY ROLLUP (region, nation)"),
    "dp_cube": ("li_daily", "SELECT returnflag, linestatus, sum(value) AS s FROM DataPoint GROUP BY CUBE (returnflag, linestatus)"),
    "dp_distinct": ("ord_weekly", "SELECT DISTINCT region, value FROM DataPoint"),
    "dp_filter_clause": ("li_daily", "SELECT tid, count(*) FILTER (WHERE value > 20) AS n, count(DISTINCT value) AS d FROM DataPoint GROUP BY tid"),
    "dp_stddev": ("li_daily", "SELECT tid, round(stddev_samp(value), 4) AS s FROM DataPoint GROUP BY tid"),
    "dp_union": ("li_daily", "SELECT tid, value FROM DataPoint WHERE tid = 1 UNION SELECT tid, value FROM DataPoint WHERE tid = 2"),
    "dp_intersect": ("li_daily", "SELECT value FROM DataPoint WHERE tid = 1 INTERSECT SELECT value FROM DataPoint WHERE tid = 2"),
    "dp_except": ("li_daily", "SELECT value FROM DataPoint WHERE tid = 1 EXCEPT SELECT value FROM DataPoint WHERE tid = 3"),
    "dp_topk": ("li_daily", "SELECT tid, timestamp, value FROM DataPoint ORDER BY value DESC, tid, timestamp LIMIT 10"),
    "dp_sort_offset": ("ord_weekly", "SELECT tid, timestamp FROM DataPoint ORDER BY tid, timestamp LIMIT 20 OFFSET 30"),
    "dp_tumbling": ("ev_minute", "SELECT tid, date_trunc('day', timestamp) AS w, sum(value) AS s FROM DataPoint GROUP BY 1, 2"),
    "group_scan_time": ("ev_minute", "SELECT date_trunc('month', timestamp) AS w, min(value) AS a, max(value) AS z, avg(value) > 0 AS ok FROM DataPoint GROUP BY 1"),
}
PLAIN |= {
    "dp_time_plus_interval": ("li_daily", f"SELECT tid, count(*) AS n FROM DataPoint WHERE timestamp < TIMESTAMP '{T0}' + INTERVAL '40' DAY GROUP BY tid"),
    "dp_time_interval_left": ("li_daily", f"SELECT tid, count(*) AS n, sum(value) AS s FROM DataPoint WHERE INTERVAL '30' DAY + timestamp >= TIMESTAMP '{T1}' GROUP BY tid"),
    "dp_time_between": ("li_daily", f"SELECT tid, count(*) AS n FROM DataPoint WHERE timestamp BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '1996-10-01' GROUP BY tid"),
    "dp_time_or": ("li_daily", f"SELECT count(*) AS n FROM DataPoint WHERE timestamp < TIMESTAMP '1993-01-01' OR timestamp >= TIMESTAMP '{T1}'"),
    "dp_time_two_bounds": ("li_daily", "SELECT count(*) AS n FROM DataPoint WHERE timestamp >= TIMESTAMP '1996-09-01' AND timestamp >= TIMESTAMP '1996-10-01' AND NOT timestamp > TIMESTAMP '1997-01-31'"),
    "dp_time_in_subquery": ("li_daily", f"SELECT (SELECT count(*) FROM DataPoint WHERE timestamp < TIMESTAMP '{T0}') AS a, count(*) AS b FROM DataPoint WHERE timestamp >= TIMESTAMP '{T1}'"),
    "dp_join_comma": ("li_daily", "SELECT d.tid, count(*) AS n FROM DataPoint d, (SELECT 1 AS tid, TIMESTAMP '1998-01-01' AS timestamp UNION ALL SELECT 2, TIMESTAMP '1990-01-01') e WHERE e.timestamp >= TIMESTAMP '1997-01-01' AND d.tid >= e.tid GROUP BY d.tid"),
    "dp_self_join": ("li_daily", f"SELECT a.tid, count(*) AS n FROM DataPoint a JOIN DataPoint b ON a.tid = b.tid AND a.timestamp = b.timestamp + INTERVAL '1' DAY WHERE a.timestamp >= TIMESTAMP '{T0}' AND b.value > 10 GROUP BY a.tid"),
    "dp_cte_twice": ("li_daily", "WITH x AS (SELECT tid, value, timestamp FROM DataPoint WHERE tid IN (1, 2)) SELECT a.n AS n, b.n AS m FROM (SELECT count(*) AS n FROM x WHERE tid = 1) a, (SELECT count(*) AS n FROM x WHERE tid = 2) b"),
    "dp_percent_rank": ("ord_weekly", "SELECT tid, timestamp, round(percent_rank() OVER (PARTITION BY tid ORDER BY value), 6) AS r, round(cume_dist() OVER (PARTITION BY tid ORDER BY value), 6) AS c FROM DataPoint"),
    "dp_lead_nth": ("ord_weekly", "SELECT tid, timestamp, lead(value, 2) OVER (PARTITION BY tid ORDER BY timestamp) AS l, nth_value(value, 3) OVER (PARTITION BY tid ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM DataPoint"),
    "dp_range_frame": ("ord_weekly", "SELECT tid, timestamp, sum(value) OVER (PARTITION BY tid ORDER BY timestamp RANGE BETWEEN INTERVAL '21' DAY PRECEDING AND CURRENT ROW) AS s FROM DataPoint"),
    "dp_intersect_all": ("li_daily", "SELECT value FROM DataPoint WHERE tid = 1 INTERSECT ALL SELECT value FROM DataPoint WHERE tid = 2"),
    "dp_except_all": ("li_daily", "SELECT value FROM DataPoint WHERE tid = 1 EXCEPT ALL SELECT value FROM DataPoint WHERE tid = 3"),
    "dp_string_functions": ("ord_weekly", "SELECT upper(substr(nation, 1, 3)) AS k, max(length(nation)) AS l, min(replace(region, 'A', '-')) AS r, count(*) AS n FROM DataPoint WHERE lower(nation) LIKE '%an%' GROUP BY 1"),
    "dp_math_functions": ("ord_weekly", "SELECT tid, round(sum(sqrt(value)), 4) AS q, sum(floor(value / 2)) AS f, max(greatest(value, 3)) AS g, sum(abs(value - 4)) AS a FROM DataPoint GROUP BY tid"),
}
for name, (data, q) in PLAIN.items():
    add(name, data, q, q.replace("DataPoint", "p").replace("sum(value)", "sum(value::double)").replace("avg(value)", "avg(value::double)").replace("stddev_samp(value)", "stddev_samp(value::double)"))
add("dp_join_range", "ev_hourly", lambda e: temporal.interval_join(e.sql("SELECT tid, start_time, end_time FROM Segment"), e.sql("SELECT tid, timestamp FROM DataPoint"), "tid", "start_time", "end_time", "timestamp").groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "select tid, count(*) n from p group by 1")
add("dp_join_asof", "ev_hourly", lambda e: temporal.asof_join(e.sql("SELECT tid, explode(sequence(TIMESTAMP '2024-01-05', TIMESTAMP '2024-03-25', INTERVAL '1' DAY)) AS at FROM (SELECT DISTINCT tid FROM Segment) q"), e.sql("SELECT tid, timestamp, value AS v FROM DataPoint"), "tid", "at", "timestamp", ["v"]),
    "select u.tid, u.ts as \"at\", d.value v from (select distinct tid, unnest(generate_series(timestamp '2024-01-05', timestamp '2024-03-25', interval 1 day)) ts from p) u asof left join p d on d.tid = u.tid and d.timestamp <= u.ts")
add("dp_join_lateral", "ord_weekly", "SELECT n.n_nationkey, q.s, q.m FROM nation n, LATERAL (SELECT sum(value) AS s, max(value) AS m FROM DataPoint d WHERE d.nation = n.n_name) q", "select n.n_nationkey, q.s, q.m from nation n, lateral (select sum(value::double) as s, max(value) as m from p d where d.nation = n.n_name) q")
add("dp_pivot", "li_daily", "SELECT * FROM (SELECT returnflag, linestatus, value FROM DataPoint) PIVOT (sum(value) FOR linestatus IN ('F' AS f, 'O' AS o))", "select returnflag, sum(case when linestatus = 'F' then value::double end) f, sum(case when linestatus = 'O' then value::double end) o from p group by 1")
add("dp_sliding", "ev_hourly", lambda e: e.sql("SELECT * FROM DataPoint").groupBy("tid", F.window("timestamp", "2 days", "1 day").alias("w")).agg(F.sum("value").alias("s")).select("tid", F.col("w.start").alias("w"), "s"),
    "select tid, d - interval (k) day as w, sum(value::double) s from (select tid, date_trunc('day', timestamp) d, value from p), (select unnest([0, 1]) k) group by 1, 2")
add("dp_session", "ev_minute", lambda e: e.sql("SELECT * FROM DataPoint").groupBy("tid", F.session_window("timestamp", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("tid", F.col("w.start").alias("start"), "n"),
    "select tid, min(timestamp) as start, count(*) n from (select *, sum(case when timestamp <= b + interval 1 hour then 0 else 1 end) over (partition by tid order by timestamp) g from (select *, lag(timestamp) over (partition by tid order by timestamp) b from p)) group by tid, g")
add("group_correlated_scan", "ord_weekly", "SELECT tid, timestamp, value FROM DataPoint", "select tid, timestamp, value from p", clause="Location 1")
add("group_correlated_aggregates", "ord_weekly", "SELECT region, SUM_S(#) AS s, MIN_S(#) AS a, MAX_S(#) AS z FROM Segment GROUP BY region", "select region, sum(value::double) s, min(value) a, max(value) z from p group by 1", clause="Location 1")
add("group_split_scan", "ord_weekly", "SELECT tid, count(*) AS n, sum(value) AS s FROM DataPoint GROUP BY tid", "select tid, count(*) n, sum(value::double) s from p group by 1", clause="Location 1", split_fraction=0.9, length_bound=20)
add("scaling_factor", "li_daily", "SELECT tid, MIN_S(#) AS a, MAX_S(#) AS z, SUM_S(#) AS s FROM Segment GROUP BY tid", "select tid, min(value) a, max(value) z, sum(value::double) s from p group by 1", clause="* A_F 0.5, * N_O -1, * R_F 2")
for bound in (1, 5, 10):
    add(f"lossy_bound_{bound}_violations", "li_daily", lambda e, bound=bound: violations(e, bound), "select 0::bigint violations, count(*) n from p", error_bound=float(bound))
for m in ("pmc_mean", "swing_filter", "gorilla"):
    add(f"model_forced_{m}", "ev_hourly", "SELECT tid, timestamp, value FROM DataPoint", "select tid, timestamp, value from p", models=(m,))
add("model_forced_uncompressed", "ev_hourly", "SELECT tid, timestamp, value FROM DataPoint", "select tid, timestamp, value from p", models=())
add("derived_aggregates", "li_daily", "SELECT tid, SUM_S(#) AS s, MIN_S(#) AS a FROM Segment WHERE tid > 6 GROUP BY tid", "select 7::int tid, sum(value::double * 2 + 1) s, min(value * 2 + 1)::float a from p where tid = 1", derived=(("A_F", "value * 2 + 1", (("returnflag", "D"), ("linestatus", "F"))),))
add("derived_points", "li_daily", "SELECT tid, timestamp, value FROM DataPoint WHERE tid > 6", "select 7::int tid, timestamp, (value * 2 + 1)::float as value from p where tid = 1", derived=(("A_F", "value * 2 + 1", (("returnflag", "D"), ("linestatus", "F"))),))
add("segment_stats", "li_daily", lambda e: e.stats().agg(F.sum("points").alias("points"), F.count(F.when(~(F.col("ratio") > 0), 1)).alias("without_ratio")), "select count(*)::bigint points, 0::bigint without_ratio from p")
add("dp_percentile", "li_daily", "SELECT tid, round(percentile(value, 0.5), 4) AS m, round(percentile(value, 0.9), 4) AS h, approx_count_distinct(tid) AS d FROM DataPoint GROUP BY tid", "select tid, round(quantile_cont(value::double, 0.5), 4) m, round(quantile_cont(value::double, 0.9), 4) h, 1::bigint d from p group by 1")
add("dp_json", "ord_weekly", "SELECT get_json_object(to_json(named_struct('t', tid, 'v', value)), '$.t') AS t, count(*) AS n FROM DataPoint GROUP BY 1", "select tid::varchar t, count(*) n from p group by 1")
add("store_orc_scan", "li_daily", "SELECT tid, timestamp, value FROM DataPoint WHERE tid < 3", "select tid, timestamp, value from p where tid < 3", store="orc")
add("store_compacted_scan", "li_daily", lambda e: compacted(e).sql("SELECT tid, timestamp, value FROM DataPoint"), "select tid, timestamp, value from p", length_bound=48)
add("latency_bounded_scan", "li_daily", "SELECT tid, timestamp, value FROM DataPoint", "select tid, timestamp, value from p", maximum_latency=3, length_bound=40)
add("stream_bulk_scan", "ev_hourly", lambda e: streamed(e, "bulk").sql("SELECT tid, timestamp, value FROM DataPoint"), "select tid, timestamp, value from p")
add("stream_online_scan", "ev_hourly", lambda e: streamed(e, "online", end=False, maximum_latency=1).sql("SELECT tid, timestamp, value FROM DataPoint"), "select tid, timestamp, value from p")
add("transfer_scan", "ord_weekly", lambda e: transferred(e).sql("SELECT tid, timestamp, value FROM DataPoint"), "select tid, timestamp, value from p")


def fresh(e: Engine, **changes) -> Engine:
    """An engine with the same series and settings and an empty store."""
    out = Engine(e.spark, Store(e.spark, f"{shared_dir(e.spark)}/engine-{uuid.uuid4().hex}"), replace(e.settings, **changes))
    out.store.upsert_series(e.store.series().drop("gid_bucket"))
    out.store.write_models({r["name"]: r["mtid"] for r in e.store.models().collect()})
    return out


def compacted(e: Engine) -> Engine:
    """The same segments, stored in three batches and rewritten into one."""
    out = fresh(e)
    for k in range(3):
        out.store.append_segments(e.store.segments().drop("gid_bucket").where(F.pmod(F.hash("start_time"), F.lit(3)) == k))
    out.store.optimize()
    return out


def streamed(e: Engine, mode: str, end: bool = True, **changes) -> Engine:
    """The engine's points, streamed from files into another store."""
    out = fresh(e, **changes)
    folder = f"{shared_dir(e.spark)}/stream-{uuid.uuid4().hex}"
    names = e.store.series().select("tid", "source")
    points = e.sql("SELECT tid, timestamp, value FROM DataPoint").join(names, "tid").select("source", "timestamp", "value")
    points.orderBy("timestamp").coalesce(1).write.parquet(f"{folder}/in")
    if end:
        ingest.end_of_input(out).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = e.spark.readStream.schema("source string, timestamp timestamp, value float").parquet(f"{folder}/in")
    ingest.ingest_stream(out, rows, f"{folder}/state", mode).awaitTermination()
    return out


def transferred(e: Engine) -> Engine:
    """The engine's segments, sent twice over a folder to a centre, which takes each batch once."""
    out, folder = fresh(e), f"{shared_dir(e.spark)}/transfer-{uuid.uuid4().hex}"
    for _ in range(2):
        transfer.send(e, folder)
    transfer.receive(out, folder, f"{folder}-state").awaitTermination()
    return out


def violations(e: Engine, bound: int) -> DataFrame:
    """Points of the lossy store outside the bound, and all points."""
    lossy = e.sql("SELECT tid, timestamp, value AS approx FROM DataPoint")
    d = next(k[1] for k, x in _engines.items() if x is e)
    exact = engine(e.spark, d, "li_daily").sql("SELECT tid, timestamp, value FROM DataPoint")
    miss = F.abs(F.col("value").cast("double") - F.col("approx")) / F.abs(F.col("value").cast("double")) * 100
    return exact.join(lossy, ["tid", "timestamp"]).agg(F.count(F.when(miss > bound * 1.000001, 1)).alias("violations"), F.count(F.lit(1)).alias("n"))
