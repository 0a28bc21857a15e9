"""Series from CSV, ORC, Parquet and sockets, as (source, timestamp, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The decimal and grouping signs of locales.
DECIMAL = {"en": (".", ","), "da": (",", "."), "de": (",", "."), "fr": (",", " "), "es": (",", ".")}


def expand(path: str, spark: SparkSession) -> list[str]:
    """A file, a folder's visible files, a glob, or ip:port, sorted, on any file system that Hadoop knows."""
    if is_socket(path):
        return [path]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(c in path for c in "*?[{"):
        if not fs.exists(at):
            return []
        if fs.getFileStatus(at).isFile() or path.rstrip("/").endswith((".orc", ".parquet")):
            return [path]
        path = f"{path.rstrip('/')}/*"
    found = [s.getPath() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) or []]
    return sorted(p.toString() for p in found if not p.getName().startswith((".", "_")))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sources under a path: those of the files, as the readers give them."""
    return [f if is_socket(f) else f.rstrip("/").rsplit("/", 1)[-1] for f in expand(path, spark)]


def is_socket(path: str) -> bool:
    host, _, port = path.rpartition(":")
    return bool(host) and port.isdigit() and "/" not in path


def source_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def parse_time(c: Column, date_format: str) -> Column:
    """'unix' counts seconds, 'java' milliseconds; else a date pattern in the session's time zone."""
    if date_format == "unix":
        return F.timestamp_seconds(c.cast("long"))
    if date_format == "java":
        return F.timestamp_millis(c.cast("long"))
    return F.to_timestamp(c, date_format)


def parse_value(c: Column, locale: str) -> Column:
    """A number at the beginning of the field, in the locale's notation; anything else fails."""
    point, group = DECIMAL[locale[:2].lower()]
    plain = F.replace(F.replace(c, F.lit(group), F.lit("")), F.lit(point), F.lit("."))
    number = F.regexp_extract(plain, r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("not a number: "), c)).cast("float")).otherwise(number.cast("float"))


def from_fields(lines: DataFrame, separator: str, timestamp_column: int, value_column: int, date_format: str, locale: str) -> DataFrame:
    f = F.split("value", separator)
    return lines.select("source", parse_time(F.element_at(f, timestamp_column), date_format).alias("timestamp"), parse_value(F.element_at(f, value_column), locale).alias("value"))


def read_csv(spark: SparkSession, paths: list[str], separator: str = ",", header: bool = True, timestamp_column: int = 1,
             value_column: int = 2, date_format: str = "yyyy-MM-dd HH:mm:ss", locale: str = "en") -> DataFrame:
    """Delimited text, gzip included. ``separator`` is a regular expression, columns count from 1. With ``header`` each
    file's first line is dropped; a line that can't be parsed fails the query."""
    # the reader drops the first line of each file; the whole line stays one field as no text holds U+0001
    lines = spark.read.option("sep", "\u0001").option("quote", "").option("header", str(header).lower()).option("enforceSchema", "true").schema("value string").csv(paths)
    return from_fields(lines.select(source_name().alias("source"), "value"), separator, timestamp_column, value_column, date_format, locale)


def read_columns(spark: SparkSession, fmt: str, paths: list[str], timestamp_column: str | int = 1, value_column: str | int = 2) -> DataFrame:
    """ORC or Parquet: only the two columns are read; doubles are narrowed."""
    df = spark.read.format(fmt).load(paths)
    name = lambda c: c if isinstance(c, str) else df.columns[c - 1]
    return df.select(source_name().alias("source"), F.col(name(timestamp_column)).cast("timestamp").alias("timestamp"), F.col(name(value_column)).cast("float").alias("value"))


def read_socket(spark: SparkSession, address: str, **csv) -> DataFrame:
    """A stream of delimited lines."""
    host, _, port = address.rpartition(":")
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    args = {"separator": ",", "timestamp_column": 1, "value_column": 2, "date_format": "java", "locale": "en"} | csv
    return from_fields(lines.select(F.lit(address).alias("source"), "value"), **args)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Chooses the reader by name: ip:port, .orc, .parquet, else delimited text. All files of a path are one frame."""
    files = expand(path, spark)
    if len(files) == 1 and is_socket(files[0]):
        return read_socket(spark, files[0], **options)
    kinds: dict[str, list[str]] = {}
    for f in files:
        kinds.setdefault("orc" if f.endswith(".orc") else "parquet" if f.endswith(".parquet") else "csv", []).append(f)
    parts = []
    for kind, paths in kinds.items():
        columns = {k: v for k, v in options.items() if k in ("timestamp_column", "value_column")}
        parts.append(read_csv(spark, paths, **options) if kind == "csv" else read_columns(spark, kind, paths, **columns))
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
