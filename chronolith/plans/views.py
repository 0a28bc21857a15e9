"""The two views: a row for each segment of each series, and a row for each reconstructed data point."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.models.types import PMCMean, Swing, assign_mtids
from chronolith.operators.compress import decode_arrays
from chronolith.plans.narrow import GIDS, Need
from chronolith.sources.storage import Store

BUCKETS = Store.BUCKETS
PUBLIC = ["tid", "start_time", "end_time", "mtid", "model", "offsets"]


@dataclass
class Derived:
    """A series computed from another's values by an SQL expression over ``value`` and ``scalingFactor``."""

    tid: int
    parent: int
    expression: str
    dims: dict


def int_bytes(c: Column) -> Column:
    """Big-endian 32-bit integer."""
    return F.unhex(F.lpad(F.right(F.hex(c.cast("long")), F.lit(8)), 8, "0"))


class Views:
    """Plans over stored segments and series metadata. ``series`` is small and joined by broadcast as long as the planner
    finds it so; the join is on (gid, gid_bucket), so a predicate on tid or a dimension prunes the segments' partitions."""

    def __init__(self, segments: DataFrame, series: DataFrame, models: tuple[str, ...], derived: list[Derived] = (), keep: Callable[[str, DataFrame], DataFrame] | None = None):
        self.segments, self.series, self.models, self.derived = segments, series, models, list(derived)
        self.keep = keep
        ids = assign_mtids(models)
        self.native = [ids[n] for n in (PMCMean.name, Swing.name) if n in ids]
        self.swing = ids.get(Swing.name, 0)
        self.dims = [c for c in series.columns if c not in ("tid", "scaling_factor", "sampling_interval", "gid", "source", "gid_bucket")]

    def exploded(self, need: Need | None = None) -> DataFrame:
        """A row for each segment and member that isn't in a gap, derived series besides. ``need`` narrows the scan; it may keep
        more than asked."""
        s, need = self.segments, need or Need()
        if need.low is not None:
            s = s.where(F.col("end_time") >= F.timestamp_micros(F.lit(need.low)))
        if need.high is not None:
            s = s.where(F.col("start_time") <= F.timestamp_micros(F.lit(need.high)))
        if (gids := self.gids(need)) is not None:
            s = s.where(F.col("gid").isin(*gids) & F.col("gid_bucket").isin(*{g % BUCKETS for g in gids}) if gids else F.lit(False))
        if self.keep is not None:
            s = self.keep(f"{need.low} {need.high} {gids}", s)
        m = self.series.drop("source")
        # the position among the members comes from the segment, so the join with the metadata is one-to-many on gid alone
        j = s.join(m.withColumnRenamed("gid", "g").withColumnRenamed("gid_bucket", "gb"), (s["gid"] == F.col("g")) & (s["gid_bucket"] == F.col("gb")) & F.array_contains("members", F.col("tid")))
        k = F.array_position("members", F.col("tid")).cast("int")
        j = j.select(
            "tid", "gid", "start_time", "end_time", "mtid", "model", (k - 1).alias("k"), F.size("members").alias("n"), "t_off", "si", "c0", "c1",
            F.try_element_at("stats", k).alias("stat"), F.col("scaling_factor").alias("scale"), F.lit(None).cast("string").alias("rule"), *self.dims)
        for d in self.derived:
            own = j.where((F.col("tid") == d.parent) & F.col("rule").isNull())
            j = j.unionByName(own.withColumns({"tid": F.lit(d.tid), "scale": F.lit(1.0).cast("float"), "rule": F.lit(d.expression), **{c: F.lit(v).cast(dict(self.series.dtypes)[c]) for c, v in d.dims.items()}}))
        off = F.concat(int_bytes(F.col("k") + 1), int_bytes(F.col("n")), int_bytes(F.col("t_off")))
        length = F.expr("cast((unix_millis(end_time) - unix_millis(start_time)) div si + 1 as int)")
        # values that the stored model stands for, those before a cut start included
        return j.withColumns({"offsets": off, "len": length}).withColumn("capacity", F.col("n") * (F.col("len") + F.col("t_off")))

    def transformed(self, value: Column) -> Column:
        """float32 value of the series from the stored one: divided by its factor, or the derived series' expression."""
        out = (value / F.col("scale")).cast("float")
        for d in self.derived:
            own = F.expr(f"transform(array(_raw), value -> cast({d.expression.replace('scalingFactor', 'scale')} as float))[0]")
            out = F.when(F.col("rule") == d.expression, own).otherwise(out)
        return out

    def gids(self, need: Need) -> list[int] | None:
        """Groups of the series for which the query's predicates on them can hold, a few at most; None for no limit."""
        if not need.about:
            return None
        known = self.series.select("tid", "gid", *self.dims)
        for d in self.derived:
            own = self.series.where(F.col("tid") == d.parent).select(F.lit(d.tid).alias("tid"), "gid", *[F.lit(d.dims.get(c)).cast(dict(self.series.dtypes)[c]).alias(c) if c in d.dims else F.col(c) for c in self.dims])
            known = known.unionByName(own)
        try:
            rows = known.where(" AND ".join(f"({p})" for p in need.about)).select("gid").distinct().limit(GIDS + 1).collect()
        except (AnalysisException, ParseException):  # not every expression has SQL of its own
            return None
        return None if len(rows) > GIDS else sorted(r["gid"] for r in rows)

    def segment(self, need: Need | None = None) -> DataFrame:
        return self.exploded(need).select(*PUBLIC, *self.dims)

    def parts(self, need: Need | None = None) -> DataFrame:
        """The segment view with what functions on parts need: ``_si`` and ``_scale``."""
        return self.exploded(need).select(*PUBLIC, *self.dims, F.col("si").alias("_si"), F.col("scale").cast("double").alias("_scale"))

    def points(self, need: Need | None = None) -> DataFrame:
        """(tid, timestamp, value, <dimensions>). Constant and linear segments stay in generated code; only others pass
        through the Arrow decoder, and none do where the query doesn't read ``value``, which is null then."""
        x = self.exploded(need)
        if need is not None and need.columns is not None and "value" not in need.columns:
            t = F.timestamp_millis(F.unix_millis("start_time") + F.col("i").cast("long") * F.col("si"))
            return x.select("tid", "start_time", "si", *self.dims, F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i")).select("tid", t.alias("timestamp"), F.lit(None).cast("float").alias("value"), *self.dims)
        i = F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i")
        keep = ["tid", "start_time", "si", "scale", "rule", "mtid", *self.dims]
        native = x.where(F.col("mtid").isin(*self.native) if self.native else F.lit(False)).select(*keep, "c0", "c1", "t_off", i)
        native = native.withColumn("_raw", (F.col("c0") + F.col("c1") * ((F.col("i") + F.col("t_off")).cast("long") * F.col("si"))).cast("float"))
        other = decode_arrays(x.where(~F.col("mtid").isin(*self.native) if self.native else F.lit(True)), self.models)
        other = other.select(*keep, F.posexplode("_values").alias("i", "_raw"))
        cols = [*keep, "i", "_raw"]
        p = native.select(*cols).unionByName(other.select(*cols))
        return p.select("tid", F.timestamp_millis(F.unix_millis("start_time") + F.col("i").cast("long") * F.col("si")).alias("timestamp"), self.transformed(F.col("_raw")).alias("value"), *self.dims)

    def aggregated(self, need: Need | None = None) -> DataFrame:
        """The segment view with each row's ``_len``, ``_min``, ``_max`` (float) and ``_sum`` (double), from what was stored
        with the segment. Segments of derived series are decoded, as their expression is arbitrary."""
        x = self.exploded(need)
        lo, hi = (F.col("stat.low") / F.col("scale")).cast("float"), (F.col("stat.high") / F.col("scale")).cast("float")
        cols = [*PUBLIC, *self.dims, "_si", "_scale"]
        x = x.withColumns({"_si": F.col("si"), "_scale": F.col("scale").cast("double")})
        plain = x.where(F.col("rule").isNull())
        out = plain.select(*cols, F.col("len").cast("long").alias("_len"), F.least(lo, hi).alias("_min"), F.greatest(lo, hi).alias("_max"), (F.col("stat.total") / F.col("scale")).alias("_sum"))
        if self.derived:
            v = self.values(x.where(F.col("rule").isNotNull()))
            out = out.unionByName(v.select(*cols, F.col("len").cast("long").alias("_len"), F.array_min("_v").alias("_min"), F.array_max("_v").alias("_max"), F.aggregate("_v", F.lit(0.0), lambda a, b: a + b).alias("_sum")))
        return out

    def values(self, x: DataFrame) -> DataFrame:
        """Adds ``_v``: the row's values as an array, transformed."""
        v = decode_arrays(x, self.models)
        out = F.expr("transform(_values, v -> cast(v / scale as float))")
        for d in self.derived:
            e = d.expression.replace("scalingFactor", "scale")
            out = F.when(F.col("rule") == d.expression, F.expr(f"transform(_values, value -> cast({e} as float))")).otherwise(out)
        return v.withColumn("_v", out)
