import gzip
import json
import os
import socket
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from chronolith import session
from chronolith.engine import Engine
from chronolith.models.types import REGISTRY, Uncompressed, register_model
from chronolith.operators import temporal
from chronolith.operators.compress import align
from chronolith.operators.generator import Settings
from chronolith.plans import build as build_config
from chronolith.plans import engine_queries
from chronolith.plans.grouping import group, parse_clause, parse_dimensions
from chronolith.sources import serve
from chronolith.sources import series as sources
from chronolith.sources.storage import Store
from chronolith.sources.tables import CatalogStore, JdbcStore
from chronolith.streaming import ingest as stream
from chronolith.streaming import transfer

DIMS = parse_dimensions("Location, country text, region text\n\na, DK, North\nb, DK, South\n")


def points(spark, n=200, step=60_000, gap=range(50, 60)):
    rows = [(s, k * step, float(k % 7 + i)) for i, s in enumerate("ab") for k in range(n) if not (s == "a" and k in gap)]
    return spark.createDataFrame(rows, "source string, ms long, value float").select("source", F.timestamp_millis("ms").alias("timestamp"), "value")


def build(spark, path, clause="Location 1", derived=(), **settings):
    e = Engine(spark, Store(spark, str(path)), Settings(**settings), list(derived))
    e.register({"a": 60_000, "b": 60_000}, DIMS, [parse_clause(clause, DIMS)] if clause else [])
    return e


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = build(spark, tmp_path_factory.mktemp("e"), derived=[("a", "value * 3", {"country": "X", "region": "Y"})])
    e.ingest(points(spark))
    return e


def test_group_has_one_gid_and_offsets(engine):
    r = engine.sql("SELECT tid, hex(offsets) AS o FROM Segment WHERE start_time = TIMESTAMP '1970-01-01 00:50:00'").collect()
    assert {(x["tid"], x["o"]) for x in r} == {(2, "000000010000000100000000")}


def test_views_agree(engine, spark):
    got = engine.sql("SELECT tid, COUNT_S(#) AS n, SUM_S(#) AS s, MIN_S(#) AS a, MAX_S(#) AS z, AVG_S(#) AS m FROM Segment GROUP BY tid ORDER BY tid").collect()
    want = engine.sql("SELECT tid, count(*) AS n, sum(value) AS s, min(value) AS a, max(value) AS z, avg(value) AS m FROM DataPoint GROUP BY tid ORDER BY tid").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0]["n"] == 190 and got[2]["s"] == 3 * got[0]["s"]


def test_native_plan_without_python(spark, tmp_path):
    e = build(spark, tmp_path, models=("pmc_mean",))
    e.ingest(points(spark))
    plan = e.sql("SELECT tid, SUM_S(#) AS s FROM Segment GROUP BY tid")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_time_reaches_the_scan(engine):
    plan = engine.sql("SELECT * FROM DataPoint WHERE timestamp >= TIMESTAMP '1970-01-01 02:00:00'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(end_time" in plan


def test_part_of_grouped_gorilla(engine):
    q = "SELECT x.tid, SUM_S(x.tid, x.start_time, x.end_time, x.mtid, x.model, x.offsets) AS s FROM (SELECT inline(START(#, TIMESTAMP '1970-01-01 00:05:00')) FROM Segment WHERE tid < 3 AND end_time >= TIMESTAMP '1970-01-01 00:05:00') x GROUP BY x.tid ORDER BY x.tid"
    want = engine.sql("SELECT tid, sum(value) AS s FROM DataPoint WHERE timestamp >= TIMESTAMP '1970-01-01 00:05:00' AND tid < 3 GROUP BY tid ORDER BY tid").collect()
    assert [tuple(r) for r in engine.sql(q).collect()] == [tuple(r) for r in want]


def test_calendar_in_a_zone_with_summer_time(engine, spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Copenhagen")
    try:
        got = {(r["tid"], r["field"]): r["n"] for r in engine.sql("SELECT tid, COUNT_HOUR_OF_DAY(#) AS m FROM Segment GROUP BY tid").select("tid", F.explode("m").alias("field", "n")).collect()}
        want = {(r["tid"], r["f"]): r["n"] for r in engine.sql("SELECT tid, hour(timestamp) AS f, count(*) AS n FROM DataPoint GROUP BY 1, 2").collect()}
        assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_results_and_files(engine, tmp_path):
    r = json.loads(engine.to_json("SELECT count(*) AS n FROM DataPoint WHERE tid = 1"))
    assert r["result"] == [{"n": 190}] and "time" in r
    assert isinstance(json.loads(engine.to_json("SELECT nothing FROM DataPoint"))["result"], str)
    f = tmp_path / "q.sql"
    f.write_text("-- c\nSELECT 1 AS x\n\nSELECT 2 AS x\n")
    assert [json.loads(x)["result"] for x in engine.run_file(str(f))] == [[{"x": 1}], [{"x": 2}]]
    assert sum(b.num_rows for b in engine.to_arrow("SELECT tid FROM DataPoint WHERE tid = 1")) == 190
    assert {"SEGMENT", "DATAPOINT"} <= set(engine.list_tables())


def test_storage_versions(engine, spark, tmp_path):
    e = build(spark, tmp_path)
    assert e.sql("SELECT * FROM DataPoint").count() == 0
    p = points(spark)
    e.ingest(p.where("timestamp < timestamp '1970-01-01 01:00:00'"))
    e.ingest(p.where("timestamp >= timestamp '1970-01-01 01:00:00'"))
    before = e.sql("SELECT sum(value), count(*) FROM DataPoint").first()
    e.store.optimize()
    assert len(e.store.version("segment")) == 1 and e.sql("SELECT sum(value), count(*) FROM DataPoint").first() == before
    assert e.store.allocate_ids(2, 1) == (3, 2) and e.store.allocate_ids(1, 1) == (5, 3)
    assert e.stats().agg(F.sum("points")).first()[0] == 390


def test_off_grid_is_refused_or_floored(spark):
    df = spark.createDataFrame([(1, 1, 100, 1.0, 0, 5.0), (1, 1, 100, 1.0, 130, 6.0), (1, 1, 100, 1.0, 150, 7.0)], "tid int, gid int, si int, scaling_factor float, ms long, value float").withColumn("timestamp", F.timestamp_millis("ms"))
    with pytest.raises(Exception, match="off the grid"):
        align(df).collect()
    assert {(r["ts_ms"], r["value"]) for r in align(df, "floor").collect()} == {(0, 5.0), (100, 7.0)}


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t;v\n1000;1.234,5 W\n2000;2,5\n")
    with gzip.open(tmp_path / "y.csv.gz", "wt") as f:
        f.write("t;v\n3000;7\n")
    got = sources.read(spark, str(tmp_path), separator=";", date_format="java", locale="da").collect()
    assert {(r["source"], r["timestamp"].second, r["value"]) for r in got} == {("x.csv", 1, 1234.5), ("x.csv", 2, 2.5), ("y.csv.gz", 3, 7.0)}
    (tmp_path / "bad.csv").write_text("t;v\n1000;abc\n")
    with pytest.raises(Exception, match="not a number"):
        sources.read(spark, str(tmp_path / "bad.csv"), separator=";", date_format="java").collect()
    for fmt in ("orc", "parquet"):
        points(spark).select("timestamp", F.col("value").cast("double")).coalesce(1).write.format(fmt).save(str(tmp_path / f"d.{fmt}"))
        assert sources.read(spark, str(tmp_path / f"d.{fmt}/part*"), timestamp_column="timestamp", value_column="value").count() == 390
    assert sources.expand("127.0.0.1:99", spark) == ["127.0.0.1:99"] and sources.is_socket("localhost:9999")


def test_stream_equals_batch_and_shows_temporaries(spark, tmp_path):
    e = build(spark, tmp_path / "store", maximum_latency=1)
    p = points(spark)
    files = tmp_path / "in"
    p.where("timestamp < timestamp '1970-01-01 01:20:00'").write.parquet(str(files / "a"))
    read = lambda: spark.readStream.schema("source string, timestamp timestamp, value float").parquet(str(files / "*"))
    stream.ingest_stream(e, read(), str(tmp_path / "cp"), delay_ms=0).awaitTermination()
    assert e.sql("SELECT * FROM DataPoint").count() == 150
    assert e.store.temporary().count() > 0
    p.where("timestamp >= timestamp '1970-01-01 01:20:00'").write.parquet(str(files / "b"))
    stream.ingest_stream(e, read(), str(tmp_path / "cp"), delay_ms=0).awaitTermination()
    stream.end_of_input(e).write.parquet(str(files / "c"))
    stream.ingest_stream(e, read(), str(tmp_path / "cp"), delay_ms=0).awaitTermination()
    got = {(r["tid"], r["timestamp"], r["value"]) for r in e.sql("SELECT tid, timestamp, value FROM DataPoint").collect()}
    b = build(spark, tmp_path / "batch")
    b.ingest(p)
    assert got == {(r["tid"], r["timestamp"], r["value"]) for r in b.sql("SELECT tid, timestamp, value FROM DataPoint").collect()}
    assert e.store.temporary().count() == 0


def test_late_points_are_dropped_and_counted():
    f = stream.GroupFitter((1,), 100, Settings(), 200)
    f.add([(1, 0, 1.0), (1, 300, 1.0), (1, 100, 1.0)])
    assert f.done == 100
    f.add([(1, 0, 9.0), (1, 200, 1.0)])
    assert f.late == 1
    final, temporary = f.add([(-1, 0, 0.0)])
    assert [(s.start, s.end) for s in final] == [(0, 300)] and not temporary


def test_transfer(spark, tmp_path):
    edge, centre = build(spark, tmp_path / "edge"), Engine(spark, Store(spark, str(tmp_path / "centre")))
    edge.ingest(points(spark))
    transfer.register(centre, edge.store.series())
    assert transfer.send(edge, str(tmp_path / "drop")) and transfer.send(edge, str(tmp_path / "drop")) is None
    for _ in range(2):
        transfer.receive(centre, str(tmp_path / "drop"), str(tmp_path / "cp")).awaitTermination()
    assert centre.sql("SELECT count(*) AS n FROM DataPoint").first()["n"] == 390


def test_views_stay_whole_after_a_narrowed_query(spark, engine):
    engine.open()
    every = spark.sql("SELECT count(*) FROM DataPoint").first()[0]
    assert engine.sql("SELECT count(*) FROM DataPoint WHERE timestamp < TIMESTAMP '1970-01-01 00:30:00' AND tid = 1").first()[0] < every
    assert spark.sql("SELECT count(*) FROM DataPoint").first()[0] == every
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("v") and t.name.endswith("_0")]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_reach_the_scan(engine):
    p = plan_of(engine.sql("SELECT count(*) FROM DataPoint"))
    assert "ArrowEvalPython" not in p and "model" not in p.split("ReadSchema")[-1][:200]
    p = plan_of(engine.sql("SELECT sum(value) FROM DataPoint WHERE tid = 1 AND timestamp >= TIMESTAMP '1970-01-01 00:30:00' + INTERVAL '1' MINUTE"))
    assert "EqualTo(gid," in p or "In(gid," in p
    assert "GreaterThanOrEqual(end_time,1970-01-01 00:31:00" in p
    assert "ArrowEvalPython" not in plan_of(engine.sql("SELECT inline(START_END(#, TIMESTAMP '1970-01-01 00:10:00', TIMESTAMP '1970-01-01 00:30:00')) FROM Segment"))


def test_two_writers_lose_nothing(spark, tmp_path, engine):
    """Both have seen the same state before either publishes."""
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    seg = engine.store.segments().drop("gid_bucket")
    n = seg.count()
    was = b.state
    first = [a.state()]
    b.state = lambda: first.pop() if first else was()
    a.append_segments(seg)
    b.append_segments(seg)  # begins from the state before a's change, and has to begin again
    assert Store(spark, str(tmp_path / "s")).segments().count() == 2 * n
    ids = [s.allocate_ids(3, 2) for s in (a, b, a)]
    assert sorted(ids) == [(1, 1), (4, 3), (7, 5)]
    assert a.vacuum(0) == [] and len(a.version("segment")) == 2


def test_temporary_segments_go_as_final_ones_come(spark, tmp_path, engine):
    s = Store(spark, str(tmp_path / "s"))
    seg = engine.store.segments().drop("gid_bucket")
    n = seg.count()
    s.append_segments(seg.where("false"), "0", seg.withColumn("is_final", F.lit(False)))
    assert s.segments().where("not is_final").count() == n
    reader = s.segments()  # of the state before
    s.append_segments(seg, "1", seg.select("gid").distinct().join(seg.where("false").withColumnRenamed("gid", "g"), F.col("gid") == F.col("g"), "left").select(*seg.columns))
    assert s.segments().where("is_final").count() == s.segments().count() == n == reader.count()


def test_batches_are_rewritten_into_one(spark, tmp_path, engine):
    s = Store(spark, str(tmp_path / "s"), "orc")
    seg = engine.store.segments().drop("gid_bucket").limit(1).persist()
    for k in range(Store.COMPACT_EVERY):
        s.append_segments(seg, str(k))
    assert len(s.version("segment")) == 1 and s.segments().count() == Store.COMPACT_EVERY
    assert len(s.vacuum(0)) == Store.COMPACT_EVERY and s.segments().count() == Store.COMPACT_EVERY


def test_user_model_types_reach_the_workers(spark, tmp_path):
    class Halved(Uncompressed):
        name = "mine"

        def payload(self):
            return b"m" + super().payload()

        @staticmethod
        def decode(payload, ticks, width, si):
            return Uncompressed.decode(payload[1:], ticks, width, si)

    register_model(Halved)
    try:
        e = Engine(spark, Store(spark, str(tmp_path / "m")), Settings(models=("mine",)))
        e.register({"a": 60_000})
        e.ingest(spark.range(70).select(F.lit("a").alias("source"), F.timestamp_millis(F.col("id") * 60_000).alias("timestamp"), F.col("id").cast("float").alias("value")))
        assert [r["value"] for r in e.sql("SELECT value FROM DataPoint ORDER BY timestamp").collect()] == [float(k) for k in range(70)]
        assert {r["name"] for r in e.stats().collect()} == {"mine"}
    finally:
        del REGISTRY["mine"]


def test_asof_looks_back_without_limit(spark):
    day = lambda c: F.timestamp_millis(F.col(c) * 86_400_000)
    left = spark.createDataFrame([(1, 50), (1, 5), (1, 0), (2, 3), (None, 3), (1, 90), (3, 1)], "k int, d long").select("k", day("d").alias("at"), F.lit("x").alias("v"))
    right = spark.createDataFrame([(1, 5, 1.0), (1, 10, 2.0), (2, 4, 3.0), (1, None, 9.0), (None, 1, 9.0)], "k int, d long, w double").select("k", day("d").alias("ts"), "w", F.lit(0).alias("at"))
    got = {(r["k"], r["at"].timestamp() // 86_400): r["w"] for r in temporal.asof_join(left, right, "k", "at", "ts", ["w"]).collect()}
    assert got == {(1, 50): 2.0, (1, 5): 1.0, (1, 0): None, (2, 3): None, (None, 3): None, (1, 90): 2.0, (3, 1): None}


def test_interval_join_against_pairs(spark):
    i = spark.createDataFrame([(1, 0, 30), (1, 10, 12), (2, 5, 4), (None, 0, 9), (1, 100, None)], "k int, a long, b long").select("k", F.timestamp_millis("a").alias("s"), F.timestamp_millis("b").alias("e"))
    p = spark.createDataFrame([(1, 10), (1, 31), (1, 30), (2, 5), (None, 3), (1, None)], "k int, t long").select("k", F.timestamp_millis("t").alias("t"))
    for bucket in (3, 1000):
        assert sorted((r["k"], r["t"].microsecond // 1000) for r in temporal.interval_join(i, p, "k", "s", "e", "t", bucket).collect()) == [(1, 10), (1, 10), (1, 30)]


CONFIG = """
storage parquet:{0}/store
source {0}/in
source.derived a.csv doubled value * 2
dimensions {0}/dims.txt
correlation {0}/groups.txt
sampling_interval 60000
csv.separator ;
csv.date_format java
error_bound 0
batch_size 3
"""


def test_engine_from_configuration(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "in" / name).write_text("t;v\n" + "".join(f"{k * 60_000};{k % 7}\n" for k in range(50)))
    (tmp_path / "dims.txt").write_text("Location, country text, region text\n\na.csv, DK, North\nb.csv, DK, South\ndoubled, DK, Far\n")
    (tmp_path / "groups.txt").write_text("Location 1\n")
    text = CONFIG.format(tmp_path)
    e = build_config.from_config(spark, text)
    assert build_config.ingest_config(e, text) == []
    assert e.store.series().select("gid").distinct().count() == 1
    assert {(r["tid"], r["region"], r["s"]) for r in e.sql("SELECT tid, region, sum(value) AS s FROM DataPoint GROUP BY tid, region").collect()} == {(1, "North", 147.0), (2, "South", 147.0), (3, "Far", 294.0)}
    again = build_config.from_config(spark, text)  # nothing new
    assert again.store.series().count() == 2 and again.settings.error_bound == 0
    assert spark.sql("SELECT 1").count() == 1


def test_many_series_are_grouped_by_their_levels(spark):
    rows = "".join(f"s{k}, c{k % 50}, r{k % 500}\n" for k in range(20_000))
    dims = parse_dimensions("Location, country text, region text\n\n" + rows)
    names = [f"s{k}" for k in range(20_000)]
    groups, _ = group(names, dict.fromkeys(names, 100), dims, [parse_clause("Location 1", dims)])
    assert len(groups) == 50 and all(len({n for n in (int(s[1:]) % 50 for s in g)}) == 1 for g in groups)


def test_store_in_a_database(spark, tmp_path):
    db = lambda: JdbcStore(spark, str(tmp_path / "log"), f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    files, inside = build(spark, tmp_path / "files"), Engine(spark, db(), Settings())
    inside.register({"a": 60_000, "b": 60_000}, DIMS)
    for e in (files, inside):
        e.ingest(points(spark))
    for q in ("SELECT tid, timestamp, value FROM DataPoint", "SELECT tid, SUM_S(#) AS s, COUNT_S(#) AS n FROM Segment GROUP BY tid", "SELECT count(*) AS n FROM DataPoint WHERE tid = 1 AND timestamp >= TIMESTAMP '1970-01-01 00:30:00'"):
        assert sorted(map(tuple, inside.sql(q).collect())) == sorted(map(tuple, files.sql(q).collect()))
    n = inside.store.segments().count()
    inside.store.append_segments(inside.store.segments().drop("gid_bucket").where("false"), "again")
    inside.store.optimize()
    inside.store.vacuum()
    assert db().segments().count() == n and len(db().version("segment")) == 1


def test_queries_over_http_and_tcp(engine):
    web, line = serve.http(engine), serve.tcp(engine)
    try:
        q = "SELECT count(*) AS n FROM DataPoint WHERE tid = 1"
        url = f"http://127.0.0.1:{web.server_address[1]}/"
        with urllib.request.urlopen(url, data=q.encode()) as r:
            assert json.loads(r.read())["result"] == [{"n": 190}]
        with urllib.request.urlopen(url + "?" + urllib.parse.urlencode({"query": q})) as r:
            assert json.loads(r.read())["result"] == [{"n": 190}]
        with socket.create_connection(line.server_address) as c:
            c.sendall(f"{q}\nSELECT nonsense\n\n".encode())
            a, b = (json.loads(x) for x in c.makefile().read().splitlines())
        assert a["result"] == [{"n": 190}] and "nonsense" in b["result"]
    finally:
        web.shutdown(), line.shutdown()


def test_store_in_a_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE kept LOCATION '{tmp_path}/kept'")
    try:
        files, inside = build(spark, tmp_path / "files"), Engine(spark, CatalogStore(spark, str(tmp_path / "log"), "kept", "parquet"), Settings())
        inside.register({"a": 60_000, "b": 60_000}, DIMS)
        for e in (files, inside):
            e.ingest(points(spark))
        for q in ("SELECT tid, timestamp, value FROM DataPoint", "SELECT tid, SUM_S(#) AS s FROM Segment GROUP BY tid"):
            assert sorted(map(tuple, inside.sql(q).collect())) == sorted(map(tuple, files.sql(q).collect()))
        n = inside.store.segments().count()
        seg = files.store.segments().drop("gid_bucket")
        for _ in range(2):  # a stream's batch that comes again
            inside.store.append_segments(seg, "stream-1")
        assert inside.store.segments().count() == n + seg.count()
    finally:
        spark.sql("DROP DATABASE kept CASCADE")


def test_scans_are_kept_for_the_next_query(spark, tmp_path):
    e = build(spark, tmp_path / "s")
    e.cache_scans = True
    e.ingest(points(spark))
    q = "SELECT tid, count(*) AS n FROM DataPoint WHERE tid = 1 GROUP BY tid"
    first = e.sql(q).collect()
    again = e.sql(q)
    assert again.collect() == first and "InMemoryTableScan" in plan_of(again)
    assert "InMemoryTableScan" in plan_of(e.sql("SELECT max(value) FROM DataPoint WHERE tid = 1"))
    e.ingest(points(spark).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '30' DAY")))
    assert e.sql(q).first()["n"] == 2 * first[0]["n"]


def test_lineage_tables_go(spark):
    df = session.written(spark.range(3).toDF("x"), "gone")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 3 and os.path.exists(path)
    mine = session._scratch[spark.sparkContext.applicationId]
    others = [p for p in mine if not p.endswith(path.rsplit("/", 1)[-1])]
    mine[:] = [p for p in mine if p not in others]  # other tests' engines stay
    assert session.release(spark) == 1 and not os.path.exists(path)
    session._scratch[spark.sparkContext.applicationId] = others


def test_queries_read_the_tables_of_their_folder(spark, tmp_path):
    for d, regions in (("a", ["X", "Y"]), ("b", ["Z"])):
        rows = [("A", "F", k, float(k + len(regions))) for k in range(5)]
        spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, k int, l_quantity double").selectExpr("*", "cast(date_add(date '1995-01-01', k) as timestamp_ntz) as l_shipdate").write.parquet(f"{tmp_path}/{d}/lineitem.parquet")
        spark.createDataFrame(list(enumerate(regions)), "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/{d}/region.parquet")
    spark.catalog.dropTempView("region")  # another test's
    for d, want in (("a", [("X", 6.0), ("Y", 6.0)]), ("b", [("Z", 5.0)]), ("a", [("X", 6.0), ("Y", 6.0)])):
        got = engine_queries.QUERIES["dp_join_cross"](spark, f"{tmp_path}/{d}")
        assert sorted(map(tuple, got.collect())) == want
