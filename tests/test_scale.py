"""Work that must not lie with one task, one flush or the driver, however the input is cut."""

import json
import os
from dataclasses import replace

from pyspark.sql import functions as F

from planeframe import dataset
from planeframe.model import Settings
from planeframe.plans import catalog
from planeframe.sources import files, readers, writers
from planeframe.streaming.append import FrameAppender

S = Settings(width=8, height=8, pixel_type="uint8", format="ome-zarr", chunk_width=3, chunk_height=3, shard_width_chunks=2, shard_height_chunks=2)


def test_small_zarr_planes_are_dealt_over_all_cores(spark):
    rows = spark.range(0, 100, 1, 1).select(F.lit(0).alias("position_index"), F.col("id").alias("t"))
    assert writers.together(rows, S).rdd.getNumPartitions() > 1
    large = replace(S, width=2048, height=2048)
    assert writers.together(rows, large).rdd.getNumPartitions() == 1


def test_a_task_flushes_its_shards_once(tmp_path, monkeypatch):
    s = replace(S, output_path=str(tmp_path / "a.zarr"))
    flushed, settled, settle = [], [], files.settle
    monkeypatch.setattr(os, "fsync", flushed.append)
    monkeypatch.setattr(files, "settle", lambda folder: (settled.append(folder), settle(folder)))
    rows = [{"position_index": 0, "t": t, "c": 0, "z": 0, "stride": 0, "bytes": bytes([t + 1] * 64)} for t in range(3)]
    done = writers.PlaneWriter(s.to_json())._zarr(s, iter(rows))
    assert done.planes == {0: 3} and len(files.walk(s.output_path)) == 12
    assert not flushed and settled == [s.output_path]
    files.write(str(tmp_path / "document"), b"x")
    assert len(flushed) == 1


def test_tasks_of_a_scan():
    assert readers.pages_a_task(100, 64) == readers.pages_a_task(10**6, 1 << 23) == 64  # few planes, or large ones
    assert readers.pages_a_task(10**6, 64) * readers.TASKS >= 10**6  # not 15,625 tasks


def test_stream_takes_many_files_in_two_batches(spark, sf, tmp_path, monkeypatch):
    seen, append = [], FrameAppender.append
    monkeypatch.setattr(FrameAppender, "append", lambda self, batch, k: (seen.append(k), append(self, batch, k))[1])
    monkeypatch.setattr(catalog, "new_path", lambda *_: f"file://{tmp_path}/stream")
    monkeypatch.setattr(catalog, "plane_frames", lambda *a, real=catalog.plane_frames: real(*a).repartition(4))
    assert catalog.stream_zarr(spark, sf).count() == 500
    assert seen == [0, 1] and len([p for p in files.walk(f"{tmp_path}/stream/in") if p.endswith(".parquet")]) == 8


def test_strips_are_cut_by_many_tasks(spark, sf):
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1
    rows = catalog.tiff_strips(spark, sf)
    assert rows.where("rows > 0").groupBy(F.spark_partition_id()).count().count() > 4


def test_files_of_a_dataset_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a.zarr")
    for path in ("zarr.json", "0/zarr.json", *(f"0/c/{t}/0/{z}/0/0" for t in range(1200) for z in range(2))):
        files.write(f"{root}/{path}", b"x", flush=False)
    files.write(f"{root}/0/c/3/.hidden", b"x", flush=False)
    rows = dataset.stored(spark, root)
    assert sorted(r.path for r in rows.collect()) == files.walk(root) and len(files.walk(root)) == 2402
    assert rows.groupBy(F.spark_partition_id()).count().count() > 4
    assert not rows.inputFiles()  # no file of the dataset is planned by the driver


def test_frames_are_packed_by_many_tasks(spark, sf):
    assert spark.read.parquet(f"{sf}/embeddings.parquet").rdd.getNumPartitions() == 1
    rows = catalog.plane_frames(spark, sf, F.sequence(F.lit(0), F.lit(255)))
    assert rows.groupBy(F.spark_partition_id()).count().count() > 4
    assert rows.select("bytes").distinct().collect() == [(bytes(range(256)),)]


def test_frame_lines_are_written_in_pieces(spark, tmp_path, monkeypatch):
    s = replace(S, output_path=f"file://{tmp_path}/a.zarr", position_count=3)
    files.write(f"{s.output_path}/1/old", b"")
    rows = [(k % 2 * 2, 10 * k + 1 if k % 2 else 7 * k) for k in range(40)]
    frames = spark.createDataFrame(rows, "position_index int, output_index long").selectExpr("*", "output_index as t", "0 as c", "0 as z", "cast(1 as decimal(20,0)) as frame_index", "cast(2 as decimal(20,0)) as timestamp_ns", "0.0D as exposure_ms", "cast(null as struct<x_um:double,y_um:double,z_um:double>) as stage", "cast(null as map<string,string>) as metadata")
    monkeypatch.setattr(writers, "LINES_A_PIECE", 50)
    moved, joined = [], []
    monkeypatch.setattr(writers, "join_lines", lambda spark, s, folder, *a, real=writers.join_lines: (moved.append(folder), joined.extend(files.walk(folder)), real(spark, s, folder, *a)))
    writers.write_lines(frames, s)
    for k in (0, 1, 2):
        lines = files.read(f"{s.output_path}/{k}/{writers.zarr_meta.frames_name(s)}").decode().splitlines()
        assert [int(json.loads(x)["outputIndex"]) for x in lines] == sorted(i for p, i in rows if p == k)
    assert len(joined) == len({(p, i // 50) for p, i in rows}) > 10 and not files.exists(moved[0])


def test_small_files_cost_one_opening_each(tmp_path, monkeypatch):
    made, opened = [], []
    monkeypatch.setattr(os, "makedirs", lambda path, *a, real=os.makedirs, **b: (made.append(path), real(path, *a, **b)))
    monkeypatch.setattr(os, "open", lambda path, *a, real=os.open, **b: (opened.append(path), real(path, *a, **b))[1])
    put = files.many()
    for k in range(20):
        put(f"file://{tmp_path}/z/{k // 10}/{k}", b"old" * (k + 1))
    put(f"{tmp_path}/z/1/19", b"new")
    assert len(opened) == 21 and len([x for x in made if x.startswith(f"{tmp_path}/z/")]) == 2
    assert sorted(n for _, _, names in os.walk(tmp_path) for n in names) == sorted(map(str, range(20)))
    assert files.read(f"{tmp_path}/z/0/3") == b"old" * 4 and files.read(f"{tmp_path}/z/1/19") == b"new"


def test_a_log_with_large_ids_keeps_its_order(spark, tmp_path):
    """Ids a multiple of 100,000 apart at one time, as in copies of a table."""
    rows = [(k * 100_000, 3 * k, "signup") for k in range(3)]
    log = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("*", "timestamp'2024-01-01 01:00:00' as ts", "1.0D as value", "'{}' as props")
    log.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.plane_index for r in catalog.stream_admit(spark, str(tmp_path)).collect()) == [0, 1, 2]
