"""Datasets as a whole: write a DataFrame of frames, scan it back, fetch one frame."""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .model import PlaneFrameError, Settings
from .operators import admission
from .operators.schema import frames as as_frames
from .sources import files, writers
from .sources.writers import PlaneSource


def register(spark: SparkSession) -> None:
    """Makes the format name known to a session."""
    spark.dataSource.register(PlaneSource)


def planned(df: DataFrame, s: Settings, bucket: Column | None = None, max_gap: int | None = None, start: dict[int, int] | None = None, written_before: int = 0, tables: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(planes to write, rejected frames) of an input; planes of OME formats are admitted, filled and numbered.

    The input is evaluated twice: once without payloads, whose validated rows are written to the shared folder in ranges of ``seq``, and once for the payloads, which
    accepted frames then meet in one join. Windows see the written rows only, range by range (or by ``bucket``). ``seq`` must be unique within a position, for plain TIFF and binary files
    in the whole input. ``start`` and ``written_before`` are what earlier batches of a stream left; ``tables`` gets the written tables,
    which the caller may forget when both results have been used.
    """
    rows = as_frames(df)
    plain = s.format in ("binary", "tiff")
    checked = admission.validated(rows, s, coordinates=s.format != "binary").drop("bytes")
    checked = workspace.written(admission.ordered(checked), "checked")
    if tables is not None:
        tables.append(checked)
    key = ["seq"] if plain else ["position_index", "seq"]
    if not checked.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        raise PlaneFrameError("seq repeats, so frames have no order" if plain else "seq repeats within a position, so frames have no order")
    bucket = F.col("order_bucket") if bucket is None else bucket
    payload = rows.select("position_index", "seq", "bytes")
    if plain:
        good = admission.output_index(checked.where("reason is null").drop("reason"), bucket=bucket)
        good = good.withColumns({"is_fill": F.lit(False), "output_index": F.col("output_index") + written_before, "plane_index": F.col("seq")})
        return payload.join(good.drop("order_bucket"), ["position_index", "seq"]), checked.where("reason is not null").drop("order_bucket")
    accepted, rejected = admission.judged(checked, s, bucket=bucket, start=start)
    accepted = admission.output_index(accepted, bucket=bucket).withColumn("output_index", F.col("output_index") + written_before).drop("order_bucket")
    real = payload.join(accepted, ["position_index", "seq"]).withColumn("is_fill", F.lit(False))
    gaps = admission.fills(accepted, s, max_gap).withColumn("is_fill", F.lit(True))
    return real.unionByName(gaps, allowMissingColumns=True), rejected.drop("order_bucket")


def write(df: DataFrame, settings: Settings, strict: bool = True, bucket: Column | None = None, max_gap: int | None = None) -> DataFrame:
    """Writes frames as a dataset and returns the rejected ones; ``strict`` raises for the first of them instead.

    Zarr shards are written where the planes are, without a shuffle. A TIFF or binary file has one writer, so a position's planes meet in one
    task there, in page order; tasks stream them and hold two planes at most.
    """
    s = settings.opened()
    register(df.sparkSession)
    tables: list[DataFrame] = []
    try:
        planes, rejected = planned(df, s, bucket, max_gap, tables=tables)
        if strict:
            bad = rejected.select("position_index", "seq", "reason").orderBy("seq").first()
            if bad:
                raise PlaneFrameError(f"frame {bad.seq} of position {bad.position_index}: {bad.reason}")
        writers.prepare(s)
        columns = ["position_index", "plane_index", "output_index", "t", "c", "z", "is_fill", "camera_id", "frame_index", "timestamp_ns", "stride", "source_roi", "exposure_ms", "stage", "metadata", "bytes"]
        planes = planes.select(*columns)
        writers.together(writers.with_defaults(planes), s).write.format("planeframe").option("settings", s.to_json()).mode("append").save()
        if s.format == "ome-zarr":
            writers.write_lines(writers.with_defaults(planes.where("not is_fill").drop("bytes")), s)
        return workspace.written(rejected, "rejected")
    finally:
        for t in tables:
            workspace.forget(t)


def scan(spark: SparkSession, path: str, kind: str, index: str = "", pixels: bool = True, vendor: str = "planeframe", only: dict | None = None) -> DataFrame:
    """The frames of a dataset, all or those with the wanted values of its keys: ``only={"t": range(70, 76), "c": 1, "z": [0, 2]}`` reads no other file, page or record."""
    register(spark)
    wanted = {k: {"range": [v.start, v.stop]} if isinstance(v, range) and v.step == 1 else v if isinstance(v, int) else list(v) for k, v in (only or {}).items()}
    return spark.read.format("planeframe").options(path=path, kind=kind, index=index, pixels=str(pixels).lower(), vendor=vendor, only=json.dumps(wanted)).load()


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below a folder that all machines see. One task lists its upper levels until there are folders enough, all tasks what is below them:
    Spark's own file sources send the status of every file to the driver and plan them there, which a Zarr dataset of millions of shards does not bear."""
    schema, many = "path string, folder boolean", 1000

    def table(paths: list[str], folder: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([folder] * len(paths), pa.bool_())], ["path", "folder"])

    def upper(it):
        for batch in it:
            for path in batch.column(0).to_pylist():
                folders = [path]
                while folders and len(folders) < many:
                    level, folders = folders, []
                    for f in level:
                        below, found = files.entries(f)
                        folders += below
                        yield table(found, False)
                for k in range(0, len(folders), 10_000):
                    yield table(folders[k : k + 10_000], True)

    def lower(it):
        for batch in it:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for k in range(0, len(rows), 100):
                yield table([p for path, folder in rows[k : k + 100] for p in (files.walk(path) if folder else [path])], False)

    start = spark.createDataFrame([(root,)], "path string").coalesce(1)
    dealt = start.mapInArrow(upper, schema).repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(lower, schema).select("path")


@dataclass(frozen=True)
class Location:
    """Where a frame is: the frame number for TIFF and binary files, t, c and z for Zarr."""

    kind: str
    path: str
    frame_metadata_path: str = ""
    frame_number: int = 0
    position_index: int = 0
    t: int = 0
    c: int = 0
    z: int = 0


def frame(spark: SparkSession, where: Location):
    """The row of one frame; raises PlaneFrameError if it is not there."""
    if not where.path:
        raise PlaneFrameError("dataset path is required")
    if where.kind == "binary" and not where.frame_metadata_path:
        raise PlaneFrameError("binary frames need their index")
    if not files.exists(where.path):
        raise PlaneFrameError(f"dataset does not exist: {where.path}")
    if where.kind == "ome-zarr":
        only = {"position_index": where.position_index, "t": where.t, "c": where.c, "z": where.z}
    else:
        only = {"position_index": where.position_index, "frame_number": where.frame_number}
    rows = scan(spark, where.path, where.kind, where.frame_metadata_path, only=only)
    try:
        found = rows.collect()
    except Exception as e:
        told = re.search(r"PlaneFrameError: (.*)", str(e))
        raise PlaneFrameError(f"frame cannot be read: {told[1] if told else str(e)[:500]}") from e
    if len(found) != 1:
        raise PlaneFrameError("frame is outside the dataset")
    return found[0]


def codec_versions() -> dict[str, str]:
    return {"tiff": "planeframe BigTIFF 1", "zlib": zlib.ZLIB_VERSION, "zstd": ".".join(map(str, zstandard.ZSTD_VERSION))}
