"""Stored segments and metadata as versioned tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.operators.compress import STORED
from chronolith.sources.files import Files

SERIES = "tid int, scaling_factor float, sampling_interval int, gid int, source string"
SEGMENTS = f"{STORED}, gid_bucket int"


class Store:
    """segment, temporary, time_series and model_type under one folder of any file system that Hadoop knows.

    The state is a numbered log entry that names the folders of all tables, their schemas and the ids given away. A writer makes
    new folders beside the old ones and claims the next number; where another writer was first, it applies its change to that
    one's state and tries again. Readers take the latest number, so they see all of a change or nothing of it. Segments are
    partitioned by ``gid_bucket`` and sorted by (gid, start_time), so predicates on gids and times skip row groups.
    """

    BUCKETS = 16
    #: Batches after which the segments' folders are rewritten into one, and log entries that are kept.
    COMPACT_EVERY, KEPT = 10, 20

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.format = spark, format
        self.files = Files(spark, path)
        self.path = self.files.root

    # The log.

    def state(self) -> tuple[int, dict]:
        """Number and content of the latest entry."""
        known = [int(n[:-5]) for n, _ in self.files.names("_log") if n.endswith(".json") and n[:-5].isdigit()]
        for number in sorted(known, reverse=True):
            text = self.files.read(f"_log/{number:012d}.json")
            if text is not None:
                return number, json.loads(text)
        return 0, {"tables": {}, "schemas": {}, "ids": [0, 0]}

    def commit(self, change: Callable[[dict], None]) -> dict:
        """Applies ``change`` to the latest state and publishes it, again on a newer one if another writer was faster."""
        while True:
            number, state = self.state()
            change(state)
            if self.files.claim(f"_log/{number + 1:012d}.json", json.dumps(state)):
                if (number + 1) % self.KEPT == 0:
                    for n, _ in self.files.names("_log"):
                        if n.endswith(".json") and int(n[:-5]) <= number + 1 - self.KEPT:
                            self.files.remove(f"_log/{n}")
                return state

    def version(self, table: str) -> list[str]:
        return self.state()[1]["tables"].get(table, [])

    def vacuum(self, older_than_ms: int = 86_400_000) -> list[str]:
        """Removes folders that the state doesn't name and that are older than that: of failed batches, and those replaced."""
        tables, gone = self.state()[1]["tables"], []
        for table in ("segment", "temporary", "time_series", "model_type"):
            for n, t in self.files.names(table):
                if n not in tables.get(table, []) and self.files.now() - t >= older_than_ms:
                    self.files.remove(f"{table}/{n}")
                    gone.append(f"{table}/{n}")
        return gone

    # Tables.

    def folder(self, df: DataFrame, table: str, batch: str | None = None, rows_a_file: int | None = None) -> str:
        """Writes rows as a folder that nothing names yet. A batch that has a name and comes again writes the same folder."""
        name = self.batch_name(batch)
        w = df.write.format(self.format).mode("overwrite")
        w = w.option("maxRecordsPerFile", rows_a_file) if rows_a_file else w
        (w.partitionBy("gid_bucket") if table in ("segment", "temporary") else w).save(self.files.uri(f"{table}/{name}"))
        return name

    @staticmethod
    def batch_name(batch: str | None) -> str:
        return f"batch={batch or uuid.uuid4().hex}"

    def put(self, state: dict, table: str, names: list[str], schema: T.StructType) -> None:
        state["tables"][table] = names
        state["schemas"][table] = schema.jsonValue()

    def replace(self, df: DataFrame, table: str) -> None:
        name = self.folder(df, table)
        self.commit(lambda s: self.put(s, table, [name], df.schema))

    def read(self, table: str, schema: str, state: dict | None = None) -> DataFrame:
        """One scan over all folders of a table. The schema is that of the latest write, so no file is looked into."""
        state = state or self.state()[1]
        known = T.StructType.fromJson(state["schemas"][table]) if table in state["schemas"] else T._parse_datatype_string(schema)
        names = state["tables"].get(table, [])
        if not names:
            return self.spark.createDataFrame([], known)
        root = self.files.uri(table)
        df = self.spark.read.format(self.format).schema(T.StructType([*known.fields, T.StructField("batch", T.StringType())]))
        return df.option("basePath", root).load([f"{root}/{n}" for n in names]).drop("batch")

    def bucketed(self, segments: DataFrame) -> DataFrame:
        """With their bucket, in ranges of gid and time, so that a large group is written by several tasks."""
        s = segments.withColumn("gid_bucket", F.pmod("gid", F.lit(self.BUCKETS)))
        return s.repartitionByRange("gid_bucket", "gid", "start_time").sortWithinPartitions("gid_bucket", "gid", "start_time")

    def append_segments(self, segments: DataFrame, batch: str | None = None, temporary: DataFrame | None = None, rows_a_file: int | None = None) -> None:
        """Adds a batch. ``temporary`` (with the gids in ``temporary_of`` rows of null time) replaces, in the same change, the
        temporary segments of the groups it names."""
        s = self.bucketed(segments)
        name = self.folder(s, "segment", batch, rows_a_file)
        made = None if temporary is None else self.temporary_batch(temporary, batch)

        def change(state: dict) -> None:
            self.put(state, "segment", [*[x for x in state["tables"].get("segment", []) if x != name], name], s.schema)
            state["batches"] = state.get("batches", 0) + 1
            if batch is not None:  # a stream repeats its last batch at most
                state["taken"] = [*state.get("taken", [])[-99:], batch]
            if made:
                self.put(state, "temporary", made[0], made[1])

        if self.commit(change)["batches"] % self.COMPACT_EVERY == 0:
            self.optimize()

    def temporary_batch(self, batch: DataFrame, name: str | None) -> tuple[list[str], T.StructType]:
        """The temporary segments of the batch's groups beside those that other groups had. Only one stream keeps temporary
        segments of a group, so the folder can be made before the change."""
        gids = batch.select("gid").distinct()
        new = batch.where("start_time is not null").withColumn("gid_bucket", F.pmod("gid", F.lit(self.BUCKETS)))
        kept = self.temporary().join(gids, "gid", "left_anti").select(*new.columns)
        every = kept.unionByName(new)
        return [self.folder(every, "temporary", f"{name or uuid.uuid4().hex}-t{uuid.uuid4().hex[:8]}")], every.schema

    def temporary(self) -> DataFrame:
        return self.read("temporary", SEGMENTS)

    def segments(self) -> DataFrame:
        """Final and temporary ones, of one state."""
        state = self.state()[1]
        final = self.read("segment", SEGMENTS, state)
        return final.unionByName(self.read("temporary", SEGMENTS, state)) if state["tables"].get("temporary") else final

    def optimize(self) -> None:
        """All batches into one, by ranges of gid and time. Batches that come meanwhile stay beside it."""
        state = self.state()[1]
        old = state["tables"].get("segment", [])
        if len(old) < 2:
            return
        s = self.bucketed(self.read("segment", SEGMENTS, state).drop("gid_bucket"))
        name = self.folder(s, "segment", f"compacted-{uuid.uuid4().hex}")

        def change(now: dict) -> None:
            held = now["tables"]["segment"]
            if all(x in held for x in old):  # else another compaction was faster
                self.put(now, "segment", [name, *[x for x in held if x not in old]], s.schema)

        self.commit(change)

    def upsert_series(self, series: DataFrame) -> None:
        while True:
            number, state = self.state()
            new = series
            if state["tables"].get("time_series"):
                kept = self.read("time_series", SERIES, state).join(series.select("tid"), "tid", "left_anti")
                new = kept.unionByName(series, allowMissingColumns=True)
            name = self.folder(new, "time_series")
            self.put(state, "time_series", [name], new.schema)
            if self.files.claim(f"_log/{number + 1:012d}.json", json.dumps(state)):
                return

    def series(self) -> DataFrame:
        return self.read("time_series", SERIES).withColumn("gid_bucket", F.pmod("gid", F.lit(self.BUCKETS)))

    def write_models(self, ids: dict[str, int]) -> None:
        self.replace(self.spark.createDataFrame([(i, n) for n, i in ids.items()], "mtid int, name string"), "model_type")

    def models(self) -> DataFrame:
        return self.read("model_type", "mtid int, name string")

    def allocate_ids(self, series: int, groups: int) -> tuple[int, int]:
        """First tid and gid of blocks of that many new ids, after those in use. No two callers get the same."""
        m = self.series().agg(F.max("tid"), F.max("gid")).first()
        first = [0, 0]

        def change(state: dict) -> None:
            first[:] = max(m[0] or 0, state["ids"][0]) + 1, max(m[1] or 0, state["ids"][1]) + 1
            state["ids"] = [first[0] + series - 1, first[1] + groups - 1]

        self.commit(change)
        return first[0], first[1]
