"""Session settings that every entry point shares."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "chronolith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    """Times without zone mean UTC everywhere in this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; only on a single machine, as in tests, a
    local folder is made where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("CHRONOLITH_SHARED_DIR")
    if not d:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = known.get() if known.isDefined() else None
    if not d:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: Tables that this process has written to cut lineage, by application. They go when it ends; see ``release``.
_scratch: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage so that a lost executor costs a
    re-read, not a recomputation, and pins results that are evaluated more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(at_exit)
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_exit() -> None:
    try:
        release()
    except Exception as e:  # noqa: BLE001 - the JVM may be gone before
        print(f"tables in the shared folder are left: {e}", file=sys.stderr)


def release(spark: SparkSession | None = None) -> int:
    """Deletes the tables that ``written`` has made in this application, whose results must no longer be read; runs by itself
    when the process ends. Returns their number."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return 0
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores, as one small file makes it, over all of them, for work that is heavier
    than moving its rows. Larger ones stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def millis(col) -> "F.Column":
    """Milliseconds since 1970-01-01 UTC of a timestamp with or without zone."""
    return F.unix_millis(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))
