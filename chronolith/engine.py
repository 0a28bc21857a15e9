"""The engine: ingest series, query them through the views Segment and DataPoint."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import segments as segment_functions
from chronolith.functions.calendar import LEVELS, piece_aggregates, pieces
from chronolith.models.types import assign_mtids, user_types
from chronolith.operators.compress import align, encode
from chronolith.operators.generator import Settings
from chronolith.operators.readings import with_source
from chronolith.plans import narrow, rewrite
from chronolith.plans.grouping import Clause, Dimensions, group
from chronolith.plans.narrow import Need
from chronolith.plans.views import PUBLIC, Derived, Views
from chronolith.sources.storage import SERIES, Store

#: Views that queries read, by users or after rewriting.
VIEWS = {"SEGMENT", "DATAPOINT", "SEGMENT_PARTS", "SEGMENT_AGGREGATES", *(f"SEGMENT_BY_{x}" for x in LEVELS)}


@dataclass
class Engine:
    """One store and the session that queries it. ``series`` must be registered before points are ingested."""

    spark: SparkSession
    store: Store
    settings: Settings = field(default_factory=Settings)
    derived: list[tuple[str | int, str, dict]] = field(default_factory=list)
    batch_size: int = 50_000
    #: Keeps the segments that the last set of predicates leaves, as long as they fill no more partitions than there are cores.
    cache_scans: bool = False
    _scan: tuple = field(default=("", None), init=False, repr=False, compare=False)
    _kept: tuple = field(default=(None, None, None), init=False, repr=False, compare=False)

    def register(self, intervals: dict[str, int], dims: Dimensions | None = None, clauses: list[Clause] = ()) -> DataFrame:
        """Assigns tids and gids to sources with these sampling intervals (ms) and stores the metadata. Returns it."""
        sources = list(intervals)
        groups, factors = group(sources, intervals, dims or Dimensions([]), list(clauses))
        tid, gid = self.store.allocate_ids(len(sources), len(groups))
        tids = {s: tid + k for k, s in enumerate(sources)}
        gids = {s: gid + k for k, g in enumerate(groups) for s in g}
        schema = SERIES + (f", {dims.schema()}" if dims and dims.columns else "")
        rows = [(tids[s], float(factors.get(s, 1.0)), intervals[s], gids[s], s, *(dims.members[s] if dims and dims.columns else ())) for s in sources]
        series = self.spark.createDataFrame(rows, schema)
        self.store.upsert_series(series)
        self.store.write_models(assign_mtids(self.settings.models))
        return series

    def ingest(self, points: DataFrame, mode: str = "strict") -> None:
        """Appends points (source, timestamp, value) of registered sources."""
        meta = self.store.series().select("source", "tid", "gid", F.col("sampling_interval").alias("si"), "scaling_factor")
        groups = meta.groupBy("gid").agg(F.array_sort(F.collect_list("tid")).alias("tids"))
        self.store.append_segments(encode(align(with_source(points, meta, "source"), mode), self.settings, groups), rows_a_file=self.batch_size)

    def views(self) -> Views:
        series = self.store.series()
        derived = []
        if self.derived:
            named = [p for p, _, _ in self.derived]
            of = F.col("source").isin(*[str(p) for p in named]) | F.col("tid").isin(*[p for p in named if isinstance(p, int)] or [-1])
            known = {x: r["tid"] for r in series.where(of).select("source", "tid").collect() for x in (r["source"], r["tid"])}
            top = series.agg(F.max("tid")).first()[0] or 0
            parents = sorted(((known[p], n, e, d) for n, (p, e, d) in enumerate(self.derived) if p in known))
            derived = [Derived(top + 1 + k, p, e, d) for k, (p, _, e, d) in enumerate(parents)]
        return Views(self.store.segments(), series, self.settings.models, derived, self.keep_scan if self.cache_scans else None)

    def keep_scan(self, predicates: str, segments: DataFrame) -> DataFrame:
        key = f"{self.store.state()[0]} {predicates}"
        if self._scan[0] != key:
            if segments.rdd.getNumPartitions() > self.spark.sparkContext.defaultParallelism:
                return segments
            if self._scan[1] is not None:
                self._scan[1].unpersist()
            self._scan = (key, segments.persist())
        return self._scan[1]

    def current(self) -> tuple[Views, dict[str, DataFrame]]:
        """Views of the store's latest state, and those of them that have been planned for all rows; kept until it changes."""
        number = (self.store.state()[0], str(self.derived))
        if self._kept[0] != number:
            self._kept = (number, self.views(), {})
        return self._kept[1:]

    def view(self, v: Views, name: str, need: Need | None = None) -> DataFrame:
        if name == "SEGMENT":
            return v.segment(need)
        if name == "DATAPOINT":
            return v.points(need)
        if name == "SEGMENT_PARTS":
            return v.parts(need)
        if name == "SEGMENT_AGGREGATES":
            return v.aggregated(need)
        return by_calendar(v, name.removeprefix("SEGMENT_BY_"), need)

    def open(self) -> Views:
        """Registers the views of all rows in the session, for queries that don't go through ``sql``. Of two engines in a
        session the last one's are there; ``sql`` reads its own engine's."""
        v = self.views()
        self.view(v, "SEGMENT").createOrReplaceTempView("Segment")
        self.view(v, "DATAPOINT").createOrReplaceTempView("DataPoint")
        return v

    def sql(self, query: str) -> DataFrame:
        """The query is planned twice: over stand-ins of the views first, which shows what it needs of each, then over the views
        narrowed to that. Neither stays registered."""
        q = rewrite.expand(query)
        q = rewrite.calendar(q) or rewrite.model_aggregates(rewrite.parts(q))
        if "SEG_VALUES" in {t.up for t in rewrite.tokens(q)}:
            segment_functions.register(self.spark, self.settings.models, user_types(self.settings.models))
        tag, places = f"v{uuid.uuid4().hex[:12]}", []

        def name(table: str, n: int) -> str | None:
            if table not in VIEWS:
                return None
            places.append(table)
            return f"{tag}_{n}"

        q = rewrite.renamed(q, name)
        v, whole = self.current()
        for t in set(places) - set(whole):
            whole[t] = self.view(v, t)
        try:
            ids = {}
            for n, t in enumerate(places):
                df, number = narrow.stand_in(self.spark, whole[t].schema)
                df.createOrReplaceTempView(f"{tag}_{n}")
                ids[number] = f"{tag}_{n}"
            plan = self.spark.sql(q)._jdf.queryExecution().optimizedPlan()
            needs = narrow.needs(plan, ids, {"tid", *v.dims})
            for n, t in enumerate(places):
                need = needs.get(f"{tag}_{n}")
                (whole[t] if need is None or need.nothing(t == "DATAPOINT") else self.view(v, t, need)).createOrReplaceTempView(f"{tag}_{n}")
            return self.spark.sql(q)
        finally:
            for n in range(len(places)):
                self.spark.catalog.dropTempView(f"{tag}_{n}")

    def list_tables(self) -> list[str]:
        """Names of all views a query can read, in upper case."""
        self.open()
        return sorted(t.name.upper() for t in self.spark.catalog.listTables())

    def register_external(self, name: str, fmt: str, path: str | None = None, **options) -> None:
        """Any source Spark reads, as a view."""
        r = self.spark.read.format(fmt).options(**options)
        (r.load(path) if path else r.load()).createOrReplaceTempView(name)

    def json_parts(self, query: str) -> Iterator[str]:
        """The text of ``to_json`` piece by piece: the driver holds one partition of the result at a time."""
        began, first = time.time(), True
        yield f'{{"query": {json.dumps(query)}, "result": '
        try:
            for r in self.sql(query).select(F.to_json(F.struct("*"))).toLocalIterator(prefetchPartitions=True):
                yield ("[" if first else ", ") + r[0]
                first = False
            yield "[]" if first else "]"
        except Exception as e:  # noqa: BLE001 - the message is what the client gets
            yield ("" if first else '], "error": ') + json.dumps(str(e))
        yield f', "time": "PT{time.time() - began:.3f}S"}}'

    def to_json(self, query: str) -> str:
        """{"time", "query", "result": [...]}; a failing query's message is the result."""
        return "".join(self.json_parts(query))

    def to_arrow(self, query: str, batch_rows: int = 1_048_576) -> Iterator[pa.RecordBatch]:
        """The result batch by batch: the driver holds one partition at a time."""
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, batch_rows):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as w:
                        w.write_batch(b.slice(at, batch_rows))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        for r in self.sql(query).mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(r["batch"])

    def run_file(self, path: str) -> list[str]:
        """Each line a query; empty lines and those that begin with -- are passed over."""
        with open(path) as f:
            return [self.to_json(q.strip()) for q in f if q.strip() and not q.strip().startswith("--")]

    def stats(self) -> DataFrame:
        """Segments, points and bytes by model type, and the compression ratio of 16 bytes a point to what is stored."""
        s = self.store.segments()
        ticks = F.expr("(unix_millis(end_time) - unix_millis(start_time)) div si + 1")
        g = s.groupBy("mtid").agg(
            F.count(F.lit(1)).alias("segments"), F.sum(ticks * F.size("members")).alias("points"),
            F.sum(F.octet_length("model")).alias("model_bytes"), F.sum(F.size("gap_tids") * 4).alias("gap_bytes"))
        total = F.col("segments") * 24 + F.col("model_bytes") + F.col("gap_bytes")
        return g.join(self.store.models(), "mtid").withColumn("ratio", F.col("points") * 16 / total)

    def with_settings(self, **changes) -> "Engine":
        return replace(self, settings=replace(self.settings, **changes))


def by_calendar(v: Views, level: str, need: Need | None = None) -> DataFrame:
    """The segment view split at a calendar level's boundaries, with each piece's aggregates."""
    x = v.exploded(need)
    cols = [*PUBLIC, *v.dims, "_field", "_len", "_min", "_max", "_sum"]
    closed = F.col("rule").isNull() & (F.col("mtid").isin(*v.native) if v.native else F.lit(False))
    native = piece_aggregates(pieces(x.where(closed), level), None)
    other = piece_aggregates(pieces(v.values(x.where(~closed)), level), F.col("_v"))
    return native.select(*cols).unionByName(other.select(*cols))
