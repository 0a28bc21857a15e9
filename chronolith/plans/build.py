"""An engine from a configuration text: store, settings, sources with their dimensions and groups, derived series."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from chronolith.engine import Engine
from chronolith.plans import config
from chronolith.plans.grouping import Dimensions, parse_clause, parse_dimensions
from chronolith.sources import series
from chronolith.sources.files import Files
from chronolith.sources.storage import Store
from chronolith.streaming.ingest import ingest_stream


def text_of(spark: SparkSession, value: str) -> str:
    """The content of a file that is named, else the text itself."""
    folder, _, name = value.rpartition("/")
    found = Files(spark, folder).read(name) if folder and "," not in value and " " not in value else None
    return value if found is None else found


def as_list(value) -> list:
    return [] if value in (None, "none") else list(value) if isinstance(value, list) else [value]


def store_of(spark: SparkSession, value: str) -> Store:
    """``parquet:path``, ``orc:path`` or a path, which is Parquet's."""
    kind, _, path = value.partition(":")
    return Store(spark, path, kind) if kind in ("parquet", "orc") else Store(spark, value)


def from_config(spark: SparkSession, text: str) -> Engine:
    """Opens the store, and registers the sources that it doesn't know yet. ``dimensions`` and ``correlation`` are texts or files
    with them. Sources are known by their names before any of their rows is read. ``source.derived`` holds a source or tid, the
    derived series' name, and an SQL expression over ``value`` and ``scalingFactor``."""
    c = config.parse(text)
    spark.conf.set("spark.sql.session.timeZone", c["time_zone"])
    dims = parse_dimensions(text_of(spark, str(c["dimensions"]))) if c["dimensions"] not in (None, "none") else Dimensions([])
    lines = [x.strip() for value in as_list(c["correlation"]) for x in text_of(spark, str(value)).splitlines() if x.strip()]
    derived = []
    for line in as_list(c["source.derived"]):
        parent, name, expression = str(line).split(" ", 2)
        of = dict(zip([n for n, _ in dims.columns], dims.members.get(name, ())))
        derived.append((int(parent) if parent.isdigit() else parent, expression, of))
    e = Engine(spark, store_of(spark, c["storage"]), config.settings(c), derived, batch_size=c["batch_size"])
    known = {r["source"] for r in e.store.series().select("source").collect()}  # metadata, a row a series
    new = [s for path in as_list(c["source"]) for s in series.names(spark, str(path)) if s not in known]
    if new:
        if not c["sampling_interval"]:
            raise ValueError("sampling_interval is needed for new sources")
        e.register({s: c["sampling_interval"] for s in new}, dims, [parse_clause(x, dims) for x in lines])
    for external in as_list(c["spark.external"]):
        name, fmt, *path = str(external).split(" ", 2)
        e.register_external(name, fmt, *path)
    return e


def ingest_config(e: Engine, text: str, checkpoint: str | None = None, mode: str = "strict") -> list[StreamingQuery]:
    """Ingests the sources of a configuration: files at once, sockets as streams, which are returned. ``checkpoint`` is their
    folder; ``spark.streaming`` gives the seconds between their batches."""
    c = config.parse(text)
    options = {"timestamp_column": c["timestamp_column"], "value_column": c["value_column"]}
    delimited = {**options, "separator": c["csv.separator"], "date_format": c["csv.date_format"], "locale": c["csv.locale"]}
    streams = []
    for path in map(str, as_list(c["source"])):
        if series.is_socket(path):
            rows = series.read(e.spark, path, **delimited)
            streams.append(ingest_stream(e, rows, f"{checkpoint}/{path.replace(':', '-')}", trigger={"processingTime": f"{c['spark.streaming']} seconds"}))
        else:
            e.ingest(series.read(e.spark, path, **delimited, header=c["csv.header"]), mode)
    return streams
