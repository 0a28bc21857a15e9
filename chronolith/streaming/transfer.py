"""Segments from edge instances to a central one, as files in a folder that both see."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolith.engine import Engine
from chronolith.operators.compress import STORED
from chronolith.sources.storage import SEGMENTS


def send(engine: Engine, folder: str) -> str | None:
    """An edge instance's final segments that haven't been sent to ``folder`` yet, as one batch of files named after the store's
    folders in it; None if there are none. A batch that is sent again after a failure replaces itself. What has been sent is
    noted in the store. Ids must come from the centre's ``allocate_ids``."""
    state = engine.store.state()[1]
    sent = state.get("sent", {}).get(folder, [])
    new = [n for n in state["tables"].get("segment", []) if n not in sent and not n.startswith("batch=compacted")]
    if not new:
        return None
    batch = hashlib.blake2b("\n".join(sorted(new)).encode(), digest_size=12).hexdigest()
    rows = engine.store.read("segment", SEGMENTS, {**state, "tables": {"segment": new}})
    rows.where("is_final").drop("gid_bucket").write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    def note(now: dict) -> None:
        held = now.setdefault("sent", {}).setdefault(folder, [])
        held += [n for n in new if n not in held]

    engine.store.commit(note)
    return batch


def register(centre: Engine, series: DataFrame) -> None:
    """The edge's series at the centre."""
    centre.store.upsert_series(series.drop("gid_bucket"))


def receive(centre: Engine, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each new batch under ``folder`` once."""
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    # a stream's list of files is its memory: a file is taken once
    rows = centre.spark.readStream.schema(f"{STORED}, batch string").parquet(folder)

    def publish(batch: DataFrame, number: int) -> None:
        centre.store.append_segments(batch.drop("batch").withColumn("is_final", F.lit(True)), f"{stream}-{number}")

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
