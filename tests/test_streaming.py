from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from planeframe import dataset
from planeframe.model import Settings
from planeframe.sources import files
from planeframe.streaming.append import FrameAppender

S = Settings(width=2, height=2, pixel_type="uint8", position_count=2)


def frames(spark, rows):
    return spark.createDataFrame([(p, k, t, bytes([v] * 4)) for p, k, t, v in rows], "position_index int, seq long, t long, bytes binary")


ROWS = [(0, 0, None, 1), (0, 1, 3, 2), (1, 2, 1, 3), (0, 3, 3, 4), (0, 4, None, 5), (1, 5, None, 6), (1, 6, 0, 7)]


def pixels(spark, path, kind):
    order = ["position_index", "frame_number"]
    return [(r.position_index, r.frame_number, bytes(r.bytes)[0]) for r in dataset.scan(spark, path, kind).orderBy(*order).collect()]


def test_batches_equal_the_whole(spark, tmp_path):
    for kind, ending in (("ome-zarr", "zarr"), ("ome-tiff", "ome.tiff")):
        whole = replace(S, output_path=str(tmp_path / f"whole.{ending}"), format=kind)
        dataset.write(frames(spark, ROWS), whole, strict=False)
        parts = replace(S, output_path=str(tmp_path / f"parts.{ending}"), format=kind)
        a = FrameAppender(parts, str(tmp_path / f"stage-{kind}"))
        for k, cut in enumerate((ROWS[:2], ROWS[2:4], ROWS[4:])):
            a.append(frames(spark, cut), k)
            a.append(frames(spark, cut), k)  # the batch comes again
            if k == 1:
                a.flush(spark)
                a = FrameAppender(parts, str(tmp_path / f"stage-{kind}"))  # a new process goes on
        a.append(frames(spark, ROWS[:2]), 0)  # an old one is ignored
        a.close(spark)
        where = [str(tmp_path / f"{n}" if kind == "ome-tiff" else tmp_path / f"{n}.{ending}") for n in ("whole", "parts")]
        assert pixels(spark, where[0], kind) == pixels(spark, where[1], kind)
        if kind == "ome-zarr":
            for p in ("0", "1"):
                assert files.read(f"{where[0]}/{p}/planeframe.frames.jsonl") == files.read(f"{where[1]}/{p}/planeframe.frames.jsonl")
                assert files.read(f"{where[0]}/{p}/0/zarr.json") == files.read(f"{where[1]}/{p}/0/zarr.json")
        rejected = spark.read.parquet(f"{tmp_path}/stage-{kind}/rejected/*").select("seq").where(F.col("seq") >= 0).collect()
        assert sorted(r.seq for r in rejected) == [3, 6]


def test_plain_files_grow(spark, tmp_path):
    """TIFF and binary files hold the frames of all batches, by batch and then by seq, after each flush."""
    rows = [(0, k, None, k + 1) for k in (3, 1, 2, 0, 9, 8, 5)]
    for kind in ("tiff", "binary"):
        path = str(tmp_path / f"run.{kind}")
        s = Settings(width=2, height=2, pixel_type="uint8", output_path=path, format=kind, frame_metadata_path=f"{path}.csv" if kind == "binary" else "")
        a = FrameAppender(s, str(tmp_path / f"stage-{kind}"))
        read = lambda: [bytes(r.bytes)[0] for r in dataset.scan(spark, path, kind, s.frame_metadata_path).orderBy("frame_number").collect()]  # noqa: B023, E731
        a.append(frames(spark, rows[:4]), 0)
        a.flush(spark)
        assert read() == [1, 2, 3, 4]
        a.append(frames(spark, rows[4:]), 1)
        a.append(frames(spark, rows[4:]), 1)
        a.close(spark)
        assert read() == [1, 2, 3, 4, 6, 9, 10]
        assert FrameAppender(s, str(tmp_path / f"stage-{kind}")).state()["written"] == 7


def broken(spark, rows):
    """Frames whose last row fails while it is written."""
    return frames(spark, rows).withColumn("bytes", F.when(F.col("seq") == rows[-1][1], F.raise_error(F.lit("the camera is gone"))).otherwise(F.col("bytes")))


def test_a_failed_batch_spares_the_earlier_ones(spark, tmp_path, monkeypatch):
    from planeframe.sources import writers

    path = str(tmp_path / "run.zarr")
    a = FrameAppender(replace(S, output_path=path, format="ome-zarr"), str(tmp_path / "stage"))
    a.append(frames(spark, ROWS[:2]), 0)
    before = pixels(spark, path, "ome-zarr")
    assert before
    with pytest.raises(Exception, match="camera"):
        a.append(broken(spark, ROWS[2:4]), 1)
    assert pixels(spark, path, "ome-zarr") == before
    fine = writers.with_defaults
    late = lambda planes: fine(planes).withColumn("bytes", F.when(F.col("seq") == 2, F.raise_error(F.lit("the disk is full"))).otherwise(F.col("bytes")))
    monkeypatch.setattr(writers, "with_defaults", late)  # the writing job itself fails, and is aborted
    with pytest.raises(Exception, match="disk"):
        a.append(frames(spark, ROWS[2:4]), 1)
    monkeypatch.setattr(writers, "with_defaults", fine)
    assert pixels(spark, path, "ome-zarr") == before and a.state()["batch"] == 0
    for k, cut in ((1, ROWS[2:4]), (2, ROWS[4:])):
        a.append(frames(spark, cut), k)
    a.close(spark)
    dataset.write(frames(spark, ROWS), replace(S, output_path=str(tmp_path / "whole.zarr"), format="ome-zarr"), strict=False)
    assert pixels(spark, path, "ome-zarr") == pixels(spark, str(tmp_path / "whole.zarr"), "ome-zarr")


def test_a_failed_write_of_a_new_dataset_leaves_nothing(spark, tmp_path):
    for kind, name in (("ome-zarr", "a.zarr"), ("tiff", "a.tiff"), ("ome-tiff", "a.ome.tiff")):
        s = replace(S, output_path=str(tmp_path / kind / name), format=kind, position_count=1)
        rows = [(0, k, None, k) for k in range(6)]
        bad = frames(spark, rows).withColumn("bytes", F.when(F.col("seq") < 5, F.col("bytes")).otherwise(F.expr("if(octet_length(bytes) = 4, raise_error('gone'), bytes)")))
        with pytest.raises(Exception, match="gone"):
            dataset.write(bad, s)
        left = [p for p in files.walk(str(tmp_path / kind))] if files.exists(str(tmp_path / kind)) else []
        assert left == []
