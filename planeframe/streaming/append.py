"""Appending a stream of frames to a dataset, batch by batch.

Each batch is admitted by the same expressions as a whole input, without its payloads and in ranges of ``seq``, starting from the next plane index that earlier batches
left; frames whose plane has passed are rejected for good, there is no lateness and no watermark. The state file names its batch: a batch that
runs again after a failure starts from the same state and replaces the same files.

Zarr shards are written at once and the documents grow with every batch, so readers see a whole dataset after each. TIFF and binary files cannot grow
idempotently: their planes wait as Parquet, a folder for each batch, and ``flush`` or ``close`` builds the files from all of them. Plain TIFF and binary files
assign no planes: their frames follow each other by batch, then by ``seq``.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import workspace
from ..dataset import planned, register
from ..model import Settings
from ..sources import files, writers


class FrameAppender:
    """The state of one dataset that grows; ``staging`` is a folder of its own that all machines see."""

    def __init__(self, settings: Settings, staging: str):
        self.settings, self.staging = settings.opened(), staging
        if not files.exists(f"{staging}/state.json"):
            writers.prepare(self.settings)
            self._store({"batch": -1, "before": {}, "next": {}, "written": 0, "written_before": 0, "reach": {}})

    def _store(self, state: dict) -> None:
        files.write(f"{self.staging}/state.json", json.dumps(state).encode())

    def state(self) -> dict:
        return json.loads(files.read(f"{self.staging}/state.json"))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function. A batch that was committed already is done again from the state before it."""
        s, state = self.settings, self.state()
        spark = batch.sparkSession
        register(spark)
        if batch_id < state["batch"]:
            return
        again = batch_id == state["batch"]
        start = {int(k): n for k, n in state["before" if again else "next"].items()}
        written = state["written_before" if again else "written"]
        tables: list[DataFrame] = []
        planes, rejected = planned(batch, s, start=start, written_before=written, tables=tables)
        path = f"{self.staging}/planes/{batch_id:09d}"
        planes.write.mode("overwrite").parquet(path)
        rejected.write.mode("overwrite").parquet(f"{self.staging}/rejected/{batch_id:09d}")
        for t in tables:
            workspace.forget(t)
        planes = spark.read.parquet(path)
        found = planes.groupBy("position_index").agg((F.max("plane_index") + 1).alias("next"), (F.max("t") + 1).alias("reach"), F.sum((~F.col("is_fill")).cast("long")).alias("real")).collect()
        after = {str(k): n for k, n in start.items()} | {str(r.position_index): r.next for r in found}
        reach = dict(state["reach"])
        for r in found:
            reach[str(r.position_index)] = max(reach.get(str(r.position_index), 0), r.reach or 0)
        if s.format == "ome-zarr":
            self._grow(planes, batch_id, {int(k): n for k, n in reach.items()})
        self._store({"batch": batch_id, "before": {str(k): n for k, n in start.items()}, "next": after, "written_before": written, "written": written + sum(r.real for r in found), "reach": reach})

    def _grow(self, planes: DataFrame, batch_id: int, reach: dict[int, int]) -> None:
        """Shards of the batch, then the documents. The writer's own commit would only know this batch, so its documents are written again for all."""
        s = self.settings
        planes = writers.with_defaults(planes)
        writers.together(planes, s).write.format("planeframe").option("settings", s.to_json()).mode("append").save()
        staging = self.staging
        writers.write_lines(planes.where("not is_fill").drop("bytes"), s, lambda k: f"{staging}/lines/{k}/{batch_id:09d}.jsonl")
        writers.write_zarr_metadata(s, reach)

    def flush(self, spark) -> None:
        """Makes the dataset on disk hold all batches so far."""
        s = self.settings
        if s.format == "ome-zarr":
            writers.join_lines(spark, s, f"{self.staging}/lines")
            writers.write_zarr_metadata(s, {int(k): n for k, n in self.state()["reach"].items()})
            return
        if not files.exists(f"{self.staging}/planes"):
            return
        register(spark)
        # a batch that failed half-way may have staged planes; the state does not know it yet
        done = [f"{self.staging}/planes/{name}" for name in files.folders(f"{self.staging}/planes") if int(name) <= self.state()["batch"]]
        if not done:
            return
        planes = writers.together(writers.with_defaults(spark.read.parquet(*done)), s)
        planes.write.format("planeframe").option("settings", replace(s, overwrite=True).to_json()).mode("append").save()

    close = flush


def append_stream(stream: DataFrame, appender: FrameAppender, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends every micro-batch of ``stream``; rate limits are the source's, e.g. maxFilesPerTrigger."""
    return stream.writeStream.foreachBatch(appender.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
