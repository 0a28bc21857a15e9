"""Far too many small files rewritten into few well-sized ones."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.readings import BROADCAST_ROWS
from chronolith.session import written
from chronolith.sources.files import Files, arrow_filesystem

KEY = ["gid", "start_ms", "end_ms", "mtid", "model", "gaps"]
ORDER = ["gid", "start_ms", "end_ms", "mtid", "model", "gaps"]
#: Files are bundled by a hash of their names before they are scheduled: at least so many bundles, and at least so many a
#: group, so that loads come out even. The driver holds two numbers a bundle.
BUNDLES, BUNDLES_A_GROUP = 4096, 4
#: Rows of one row group, and the rows that a writer holds at most.
ROW_GROUP = 1 << 17
SCHEMA = "gid int, start_time timestamp_ntz, end_time timestamp_ntz, mtid int, model binary, gaps binary, copies long"


def schedule(weights: dict, groups: int) -> dict:
    """Longest first: each item goes to the group with the least load so far. Ties go to the lower number."""
    heap = [(0, g) for g in range(max(1, groups))]
    out = {}
    for item in sorted(weights, key=lambda i: (-weights[i], i)):
        load, g = heapq.heappop(heap)
        out[item] = g
        heapq.heappush(heap, (load + weights[item], g))
    return out


def records(segments: DataFrame) -> DataFrame:
    """Rows of ``segments`` with times in ms; null gaps are empty ones."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return segments.select(
        F.col("gid").cast("int"), ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), F.col("mtid").cast("int"),
        F.col("model").cast("binary"), F.coalesce(F.col("gaps").cast("binary"), F.lit(b"")).alias("gaps"), F.col("file_name"))


def fingerprint() -> "F.Column":
    """A number of a record that sums without overflow over 2^31 rows."""
    return F.xxhash64(*KEY).bitwiseAND(F.lit(0x7FFFFFFF))


def resolved(segments: DataFrame) -> DataFrame:
    """(record columns, copies, file): every record once, in one of the files that hold it (by the lowest hash of their names, a
    number that aggregates without sorting), with the number of rows that held it. Null fields equal null fields, rows of no
    file stand in one of their own."""
    file = F.xxhash64(F.coalesce(F.col("file_name"), F.lit("")))
    return records(segments).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min(file).alias("file"))


def scheduled(rec: DataFrame, target_bytes: int) -> tuple[DataFrame, dict]:
    """``rec`` with ``grp``, the output group of its file by ``schedule``, and the loads of the groups.

    A file's weight is what the records that it still holds take in memory; sizes in a listing are missing here and there, and
    count copies that have gone. A bundle of more than ``target_bytes``, as a hot file makes it, is split by a hash of its
    records.
    """
    spark = rec.sparkSession
    row_bytes = 40 + F.coalesce(F.octet_length("model"), F.lit(0)) + F.octet_length("gaps")
    total = rec.agg(F.sum(row_bytes)).first()[0] or 0
    groups = max(1, -(-total // target_bytes))
    bundles = max(BUNDLES, BUNDLES_A_GROUP * groups)
    bundle = F.pmod(F.col("file"), F.lit(bundles)).cast("int")
    got = rec.groupBy(bundle.alias("bundle")).agg(F.sum(row_bytes).alias("w")).toArrow()
    items: dict[tuple[int, int], int] = {}
    for b, w in zip(got["bundle"].to_pylist(), got["w"].to_pylist()):
        parts = max(1, -(-w // target_bytes))
        items.update({(b, p): w // parts for p in range(parts)})
    to = schedule(items, groups)
    load = np.bincount(np.array(list(to.values()), int), [items[i] for i in to], minlength=groups) if to else np.zeros(groups)
    plan = pa.table({"bundle": pa.array([b for b, _ in to], pa.int32()), "part": pa.array([p for _, p in to], pa.int32()), "grp": pa.array(list(to.values()), pa.int32())})
    plan = spark.createDataFrame(plan)
    parts = plan.groupBy("bundle").agg(F.count(F.lit(1)).alias("parts"))
    small = len(to) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    rec = rec.withColumn("bundle", bundle).join(hint(parts), "bundle").withColumn("part", F.pmod(F.xxhash64(*KEY), F.col("parts")).cast("int"))
    return rec.join(hint(plan), ["bundle", "part"]).drop("bundle", "part", "parts"), {"groups": int(groups), "largest": int(load.max()), "mean": float(load.mean())}


def compact(segments: DataFrame, files: DataFrame, out: str, target_bytes: int = 128 << 20) -> dict:
    """Writes every record once into few files of about ``target_bytes`` in memory, each ordered by gid and start_time, under
    the folder ``out`` of any file system, and publishes them by an atomic replacement of the manifest. Returns the manifest.

    Copies of a record are resolved first and counted in the column ``copies``. The files that then hold records are assigned
    to a fixed number of output groups, longest first to the least-loaded one. Rows go to the task of their group's number, are
    sorted there and streamed through pyarrow into one file, row group by row group. Each task writes under a name of its own
    attempt, so a task that is run again leaves a file that no manifest names. Before publishing, rows, copies and an
    order-free sum of fingerprints of what was written are compared with those of the input; on a difference nothing is
    published. ``files`` lists the input files, for the manifest's count. Readers use ``read_compacted``. An empty input publishes an empty manifest.
    """
    spark = segments.sparkSession
    place = Files(spark, out)
    rec = written(resolved(segments), "resolved")
    rec, loads = scheduled(rec, target_bytes)
    run, root = uuid.uuid4().hex, place.root
    rec = rec.select(*KEY, "copies", fingerprint().alias("h"), "grp")
    # by the group's number itself: a hash of it would undo the balance
    placed = rec.repartitionById(loads["groups"], F.col("grp")).sortWithinPartitions(*ORDER)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = arrow_filesystem(root)
        name = f"part-{run}-{uuid.uuid4().hex}.parquet"
        path, writer, stats, held, n = f"{folder.rstrip('/')}/{name}", None, None, [], 0

        def flush() -> None:
            nonlocal writer, held, n
            t = pa.Table.from_batches(held)
            body = pa.table({
                "gid": t["gid"], "start_time": t["start_ms"].cast(pa.timestamp("ms")), "end_time": t["end_ms"].cast(pa.timestamp("ms")),
                "mtid": t["mtid"], "model": t["model"], "gaps": t["gaps"], "copies": t["copies"]})
            writer = writer or pq.ParquetWriter(fs.open_output_stream(path), body.schema, compression="zstd")
            writer.write_table(body, row_group_size=ROW_GROUP)
            held, n = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            copies = b.column("copies")
            ends = [(b.column("gid")[i].as_py(), b.column("start_ms")[i].as_py()) for i in (0, b.num_rows - 1)]
            was = stats or {"rows": 0, "copies": 0, "h": 0, "first_gid": ends[0][0], "first_ms": ends[0][1]}
            stats = {**was, "rows": was["rows"] + b.num_rows, "copies": was["copies"] + pc.sum(copies).as_py(), "h": was["h"] + pc.sum(pc.multiply(b.column("h"), copies)).as_py(), "last_gid": ends[1][0], "last_ms": ends[1][1]}
            held.append(b)
            n += b.num_rows
            if n >= ROW_GROUP:
                flush()
        if held:
            flush()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"name": name, **stats, "bytes": fs.get_file_info(path).size}], MADE)

    made = placed.mapInArrow(write, "name string, rows long, copies long, h long, bytes long, first_gid int, first_ms long, last_gid int, last_ms long").collect()  # a row an output file
    want = records(segments).agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum(fingerprint().cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    got = tuple(int(sum(r[c] for r in made)) for c in ("copies", "h"))
    if got != (want["copies"], int(want["h"])):
        raise RuntimeError(f"compaction isn't published: wrote copies and fingerprints {got}, the input has {tuple(want)}")
    rows = [r.asDict() for r in sorted(made, key=lambda r: (r["first_gid"] is not None, r["first_gid"] or 0, r["first_ms"] or 0))]
    manifest = {"run": run, "rows": sum(r["rows"] for r in rows), "merged_rows": got[0], "input_files": files.count(), "loads": loads, "files": rows}
    place.publish("_manifest.json", json.dumps(manifest))
    return manifest


MADE = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("copies", pa.int64()), ("h", pa.int64()), ("bytes", pa.int64()), ("first_gid", pa.int32()), ("first_ms", pa.int64()), ("last_gid", pa.int32()), ("last_ms", pa.int64())])


def read_compacted(spark: SparkSession, out: str, ordered: bool = False) -> DataFrame:
    """The table that the manifest under ``out`` names. Each file is ordered; ``ordered`` merges them into one order by gid and
    start_time."""
    place = Files(spark, out)
    paths = [place.uri(x["name"]) for x in json.loads(place.read("_manifest.json") or '{"files": []}')["files"]]
    df = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    return df.orderBy("gid", "start_time") if ordered else df


def vacuum(spark: SparkSession, out: str, older_than_ms: int = 86_400_000) -> list[str]:
    """Removes files that the manifest doesn't name and that are older than that, as failed attempts and former runs leave."""
    place = Files(spark, out)
    named = {x["name"] for x in json.loads(place.read("_manifest.json") or '{"files": []}')["files"]}
    gone = [n for n, t in place.names() if n.startswith("part-") and n not in named and place.now() - t >= older_than_ms]
    for n in gone:
        place.remove(n)
    return gone
