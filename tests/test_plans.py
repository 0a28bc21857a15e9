import pytest

from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

from chronolith.functions.segments import end, start
from chronolith.plans import config, narrow, rewrite
from chronolith.plans.grouping import group, parse_clause, parse_dimensions

DIMS = parse_dimensions("Location, country text, region text\n\na, DK, North\nb, DK, South\nc, DE, South\n")


@pytest.mark.parametrize("clause,want", [
    ("Location 1", [["a", "b"], ["c"]]), ("Location 2", [["a"], ["b"], ["c"]]), ("Location 0", [["a"], ["b"], ["c"]]), ("Location -1", [["a", "b"], ["c"]]),
    ("0.5", [["a", "b"], ["c"]]), ("0.25", [["a"], ["b"], ["c"]]), ("auto", [["a", "b"], ["c"]]), ("a c", [["a", "c"], ["b"]]),
    ("Location 2 South", [["a"], ["b", "c"]]), ("a b c, Location 1", [["a", "b"], ["c"]]), ("1.0", [["a", "b", "c"]]),
])
def test_grouping(clause, want):
    got, _ = group(["a", "b", "c"], dict.fromkeys("abc", 100), DIMS, [parse_clause(clause, DIMS)])
    assert got == want


def test_scaling_and_intervals():
    got, f = group(["a", "b", "c"], {"a": 100, "b": 200, "c": 100}, DIMS, [parse_clause("1.0, * a 2, * Location 1 DE 0.5", DIMS)])
    assert got == [["a", "c"], ["b"]] and f == {"a": 2.0, "c": 0.5}


def test_dimension_weight_and_types():
    d = parse_dimensions("D, n int, 4\n\nx, 3\ny, 5\n")
    assert d.members["x"] == (3,) and d.distance(["x", "y"]) == 0.25
    with pytest.raises(ValueError):
        d.add("z", ["1", "2"])


def test_parts_of_segments():
    assert start(0, 1000, 100, 250) == 200 and start(0, 1000, 100, 250, True) == 300 and start(0, 1000, 100, 0) == 0 and start(0, 1000, 100, 1001) == 0
    assert end(0, 1000, 100, 750) == 800 and end(0, 1000, 100, 750, True) == 700 and end(0, 1000, 100, 1000) == 1000


def test_hash_expansion_leaves_strings():
    q = "SELECT COUNT_S( # ), SUM_S(#), '#' FROM Segment -- #"
    assert rewrite.expand(q) == "SELECT COUNT_S( tid, start_time, end_time ), SUM_S(tid, start_time, end_time, mtid, model, offsets), '#' FROM Segment -- #"


def test_model_aggregates():
    q = rewrite.model_aggregates(rewrite.expand("SELECT tid, SUM_S(#) FROM Segment GROUP BY tid"))
    assert "sum(_sum)" in q and "FROM segment_aggregates" in q
    q = rewrite.model_aggregates("SELECT MIN_S(x.tid, x.a, x.b, x.c, x.d, x.e) FROM (SELECT 1 FROM Segment) x")
    assert "seg_values(x.tid, x.a" in q and "FROM segment_parts" in q and "x._si" in q


def needed(spark, condition, source="DataPoint d"):
    """What Catalyst's plan tells of the stand-in of DataPoint."""
    df, number = narrow.stand_in(spark, T._parse_datatype_string("tid int, timestamp timestamp, value float, region string"))
    df.createOrReplaceTempView("needed_d")
    spark.sql("select timestamp '2024-01-05' as timestamp, 1 as tid").createOrReplaceTempView("other")
    plan = spark.sql(f"SELECT count(*) FROM {source.replace('DataPoint', 'needed_d')} WHERE {condition}")._jdf.queryExecution().optimizedPlan()
    return narrow.needs(plan, {number: "d"}, {"tid", "region"}).get("d")


def day(d):
    return (datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=d - 1)).timestamp() * 1e6


@pytest.mark.parametrize("condition,low,high", [
    ("timestamp >= TIMESTAMP '2024-01-02' AND timestamp < '2024-01-09'", 2, 9),
    ("timestamp < TIMESTAMP '2024-01-02' + INTERVAL '10' DAY", None, 12),
    ("INTERVAL '1' DAY + timestamp >= TIMESTAMP '2024-01-02'", None, None),
    ("TIMESTAMP '2024-01-02' <= timestamp", 2, None),
    ("timestamp BETWEEN '2024-1-9' AND '2024-01-10'", 9, 10),
    ("timestamp > '2024-01-03' OR tid = 1", None, None),
    ("timestamp > '2024-01-03' OR timestamp = '2024-01-02'", 2, None),
    ("NOT timestamp < '2024-01-03'", 3, None),
    ("timestamp IN (TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-05')", 3, 5)])
def test_time_bounds(spark, condition, low, high):
    n = needed(spark, condition)
    assert (n.low, n.high) == (low and day(low), high and day(high))


def test_bounds_of_another_table(spark):
    n = needed(spark, "e.timestamp >= '2024-01-04' AND d.tid = e.tid", "DataPoint d, other e")
    assert n.low is None and n.high is None


def test_needs_of_series_and_columns(spark):
    n = needed(spark, "tid = 2 AND region LIKE 'A%'")
    assert len([p for p in n.about if "2" in p or "A" in p]) >= 2 and n.columns is not None and "value" not in n.columns
    assert "value" in needed(spark, "value > 3").columns
    assert needed(spark, "d.tid = e.tid", "DataPoint d, other e").about in ([], ["(tid = 1)"], ["(`tid` = 1)"])


def test_renamed_tables():
    name = lambda t, n: f"x{n}" if t == "DATAPOINT" else None
    assert rewrite.renamed("SELECT DataPoint.tid FROM DataPoint WHERE tid > 1", name) == "SELECT DataPoint.tid FROM x0 AS DataPoint WHERE tid > 1"
    assert rewrite.renamed("select 'FROM DataPoint' from datapoint d, DataPoint AS e join DataPoint", name) == "select 'FROM DataPoint' from x0 d, x1 AS e join x2 AS DataPoint"


def test_calendar_needs_one_block():
    with pytest.raises(ValueError):
        rewrite.calendar("SELECT SUM_YEAR(#) FROM (SELECT * FROM Segment)")
    assert rewrite.calendar("SELECT 1 FROM Segment") is None


def test_config():
    c = config.parse("# c\nx.error_bound 5\nmodel_type pmc_mean\nmodel_type gorilla\ncsv.header false\ndynamic_split_fraction 0\nsource /a\n")
    assert c["error_bound"] == 5 and c["csv.header"] is False and config.settings(c).models == ("pmc_mean", "gorilla")
    for bad in ("error_bound 101", "length_bound 0", "nonsense 1"):
        with pytest.raises(ValueError):
            config.parse(bad)
