"""Writing frames: one Python data source for the four formats. Tasks write whole files under temporary names and move them; the commit writes what needs to know all of them.

``df.write.format("planeframe").option("settings", settings.to_json()).mode("append").save()`` takes rows that are already admitted,
filled and laid out; ``planeframe.dataset.write`` does that. A Zarr task writes the shards of its planes, in any order. A TIFF or binary task
writes the file of a position and must hold all of its planes in page order.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import workspace
from ..functions.text import csv_field
from ..model import PIXEL_FORMATS, PlaneFrameError, Settings, new_uuid
from ..operators.tiling import packed_plane, shard_tiles
from . import files, zarr_meta
from .ome_xml import file_entry, ome_xml
from .shards import build_shard
from .tiff_codec import PageWriter, patch_description

#: Fixed format: the columns of the binary index.
INDEX_HEADER = "camera_id,frame_index,timestamp_ns,width,height,bits_per_sample,stride,pixel_format,pixel_format_id,payload_bytes,source_roi_x,source_roi_y,source_roi_width,source_roi_height"
ROI = ("x", "y", "width", "height")
#: Bytes of a plane up to which Zarr planes are dealt over all cores.
SMALL_PLANE = 1 << 16
LINES_A_PIECE = 8192
#: What a task of each format needs of a plane.
COLUMNS = {
    "ome-zarr": ["position_index", "t", "c", "z", "stride", "bytes"],
    "ome-tiff": ["position_index", "t", "c", "z", "timestamp_ns", "exposure_ms", "stage", "metadata", "stride", "bytes"],
    "tiff": ["camera_id", "frame_index", "timestamp_ns", "source_roi", "stride", "bytes"],
    "binary": ["camera_id", "frame_index", "timestamp_ns", "source_roi", "stride", "bytes"],
}


@dataclass
class Written(WriterCommitMessage):
    """What a task made: files, and by position the planes of a TIFF file or the number of times of a Zarr array."""

    files: list
    planes: dict


def tiff_description(s: Settings, row: dict) -> bytes:
    """The JSON description of a plain TIFF page; 64-bit numbers as text."""
    name, number = PIXEL_FORMATS[s.pixel_type]
    out = {
        "schema": f"{s.vendor}.frame-metadata.v1", "linked_metadata_file": s.linked_metadata_file, "camera_id": row["camera_id"], "frame_index": str(int(row["frame_index"])),
        "timestamp_ns": str(int(row["timestamp_ns"])), "bits_per_sample": s.significant_bits, "pixel_format": name, "pixel_format_id": number,
    }
    return json.dumps(out | {f"source_roi_{k}": row["source_roi"][k] for k in ROI}, ensure_ascii=False).encode()


def index_line(s: Settings, row: dict) -> str:
    name, number = PIXEL_FORMATS[s.pixel_type]
    values = [csv_field(row["camera_id"]), int(row["frame_index"]), int(row["timestamp_ns"]), s.width, s.height, s.significant_bits, row["stride"] or s.row_bytes, name, number, len(row["bytes"]), *(row["source_roi"][k] for k in ROI)]
    return ",".join(map(str, values)) + "\n"


def targets(s: Settings) -> list[str]:
    """What an output occupies, for the overwrite rule and for cleaning up."""
    if s.format == "ome-zarr":
        return [s.output_path]
    if s.format == "binary":
        return [s.output_path, s.frame_metadata_path]
    return [s.output_path] if s.position_count == 1 or s.format == "tiff" else [os.path.dirname(s.tiff_path(0))]


def prepare(s: Settings) -> None:
    """Refuses or removes what is there already."""
    for path in targets(s):
        if files.exists(path):
            if not s.overwrite:
                raise PlaneFrameError(f"output already exists: {path}")
            files.remove(path)


def zarr_group(s: Settings, position: int) -> str:
    name = s.series_name(position)
    return f"{s.output_path}/{name}" if name else s.output_path


def write_zarr_metadata(s: Settings, reach: dict[int, int]) -> None:
    """All documents of the dataset; ``reach`` has the number of times by position."""
    if s.position_count > 1:
        files.write(f"{s.output_path}/zarr.json", zarr_meta.root_group())
        files.write(f"{s.output_path}/OME/zarr.json", zarr_meta.series_group([s.series_name(k) for k in range(s.position_count)]))
    for k in range(s.position_count):
        files.write(f"{zarr_group(s, k)}/zarr.json", zarr_meta.image_group(s, k))
        files.write(f"{zarr_group(s, k)}/0/zarr.json", zarr_meta.array_document(s, reach.get(k, 0)))


def with_defaults(planes: DataFrame) -> DataFrame:
    """Planes with what a zero-filled one does not say."""
    zero = F.lit(0).cast("decimal(20,0)")
    return planes.withColumns({"camera_id": F.coalesce("camera_id", F.lit("")), "frame_index": F.coalesce("frame_index", zero), "timestamp_ns": F.coalesce("timestamp_ns", zero), "exposure_ms": F.coalesce("exposure_ms", F.lit(0.0))})


def together(planes: DataFrame, s: Settings) -> DataFrame:
    """Planes as a task must hold them: those of a TIFF or binary file in page order, those of a Zarr array as they are, or dealt over all cores where they are small."""
    if s.format == "ome-tiff":
        return planes.repartition("position_index").sortWithinPartitions("position_index", "plane_index")
    if s.format == "ome-zarr":
        if s.row_bytes * s.height > SMALL_PLANE:
            return planes
        # rows of small planes are cheap to move, their files are the work: an input in one file would leave it to one task
        return planes.repartition(2 * planes.sparkSession.sparkContext.defaultParallelism, "position_index", "t")
    return planes.repartition(1).sortWithinPartitions("output_index")


def join_lines(spark: SparkSession, s: Settings, folder: str, path=None) -> None:
    """The frame lines of each position from the files of its batches or pieces, ``folder``/position/number.jsonl, copied in their order by a task for each position."""
    text = s.to_json()

    def copy(it):
        settings = Settings.from_json(text)
        for batch in it:
            for k in batch.column(0).to_pylist():
                target = path(k) if path else f"{zarr_group(settings, k)}/{zarr_meta.frames_name(settings)}"
                hidden = files.temporary(target)
                with files.stream(hidden) as out:
                    for source in files.walk(f"{folder}/{k}"):
                        with files.opened(source) as f:
                            while piece := f.read(1 << 20):
                                out.write(piece)
                files.replace(hidden, target)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    n = min(s.position_count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.range(0, s.position_count, 1, n).mapInArrow(copy, "id long").count()


def write_lines(frames: DataFrame, s: Settings, path=None) -> None:
    """The frame lines of each position, in output order, one file for each: ``path(position)`` or beside the position's group.

    ``frames`` are the real ones without their payloads. Tasks write pieces of some thousand lines, which a task for each position then joins. Positions without frames get an empty file.
    """
    spark, text = frames.sparkSession, s.to_json()
    target = path or (lambda k: f"{zarr_group(s, k)}/{zarr_meta.frames_name(s)}")
    pieces = workspace.new_path(spark, "lines")

    def write(it):
        settings = Settings.from_json(text)
        current = out = hidden = None

        def close():
            if out:
                out.close()
                files.replace(hidden, f"{pieces}/{current[0]}/{current[1]:012d}.jsonl")

        for batch in it:
            for row in batch.to_pylist():
                piece = row["position_index"], row["piece"]
                if piece != current:
                    close()
                    current, hidden = piece, files.temporary(f"{pieces}/{piece[0]}/{piece[1]:012d}.jsonl")
                    out = files.stream(hidden)
                out.write((zarr_meta.frame_line(settings, row) + "\n").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["lines"])
        close()

    rows = frames.select("position_index", F.call_function("div", "output_index", F.lit(LINES_A_PIECE)).alias("piece"), "output_index", "t", "c", "z", "frame_index", "timestamp_ns", "exposure_ms", "stage", "metadata")
    dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism, "position_index", "piece").sortWithinPartitions("position_index", "piece", "output_index")
    try:
        dealt.mapInArrow(write, "lines long").count()
        join_lines(spark, s, pieces, target)
    finally:
        files.remove(pieces)


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, settings: str):
        self.settings = settings
        # what is there before the first task starts is no work of this job: an earlier batch, or the file that a flush replaces
        self.grown = any(map(files.exists, targets(Settings.from_json(settings))))

    # tasks --------------------------------------------------------------------
    def write(self, iterator):
        s = Settings.from_json(self.settings)
        rows = (row for batch in iterator for row in batch.select(COLUMNS[s.format]).to_pylist())
        return {"ome-zarr": self._zarr, "ome-tiff": self._pages, "tiff": self._pages, "binary": self._binary}[s.format](s, rows)

    def _zarr(self, s: Settings, rows) -> Written:
        planes: dict[int, int] = {}
        put = files.many()
        for row in rows:
            position = row["position_index"]
            group = zarr_group(s, position)
            for y, x, tiles in shard_tiles(packed_plane(row["bytes"], s, row["stride"] or 0), s):
                put(f"{group}/0/c/{row['t']}/{row['c']}/{row['z']}/{y}/{x}", build_shard(tiles, s))
            planes[position] = max(planes.get(position, 0), row["t"] + 1)
        if planes:
            files.settle(s.output_path)  # before the task counts as done
        return Written([], planes)

    @staticmethod
    def _guarded(rows, hidden):
        """The rows; if they or what is done with them fail, unfinished files go."""
        done = False
        try:
            yield from rows
            done = True
        finally:
            if not done:
                for path in filter(None, hidden()):
                    files.remove(path)

    def _pages(self, s: Settings, rows) -> Written:
        made, planes = [], {}
        writer = out = path = hidden = None

        def close():
            if writer:
                writer.finish()
                out.close()
                files.replace(hidden, path)
                made.append(path)

        current = None
        for row in self._guarded(rows, lambda: [hidden]):
            position = 0 if s.format == "tiff" else row["position_index"]
            if position != current:
                close()
                if position in planes:
                    raise PlaneFrameError("the planes of a position are not together")
                current, path = position, s.output_path if s.format == "tiff" else s.tiff_path(position)
                hidden = files.temporary(path)
                out = files.stream(hidden)
                writer = PageWriter(out, s)
            known = planes.setdefault(position, [])
            # the first page of an OME file gets a long enough description to be replaced at commit
            text = tiff_description(s, row) if s.format == "tiff" else (b" " * 15 if not known else None)
            writer.add(packed_plane(row["bytes"], s, row["stride"] or 0), text)
            if s.format == "ome-tiff":
                known.append({"ifd": len(known)} | {k: row[k] for k in ("t", "c", "z", "timestamp_ns", "exposure_ms", "stage", "metadata")})
            elif not known:
                known.append(True)
        close()
        return Written(made, planes)

    def _binary(self, s: Settings, rows) -> Written:
        raw = index = None
        hidden = [files.temporary(p) for p in (s.output_path, s.frame_metadata_path)]
        for row in self._guarded(rows, lambda: hidden):
            if raw is None:
                raw, index = map(files.stream, hidden)
                index.write((INDEX_HEADER + "\n").encode())
            raw.write(row["bytes"])
            index.write(index_line(s, row).encode())
        if raw is None:
            return Written([], {})
        for f, source, target in zip((raw, index), hidden, (s.output_path, s.frame_metadata_path)):
            f.close()
            files.replace(source, target)
        return Written([s.output_path, s.frame_metadata_path], {})

    # driver -------------------------------------------------------------------
    def commit(self, messages) -> None:
        s = Settings.from_json(self.settings)
        messages = [m for m in messages if m is not None]
        if s.format == "ome-zarr":
            reach: dict[int, int] = {}
            for m in messages:
                for k, n in m.planes.items():
                    reach[k] = max(reach.get(k, 0), n)
            write_zarr_metadata(s, reach)
        elif s.format == "ome-tiff":
            found = {k: planes for m in messages for k, planes in m.planes.items()}
            uuids = {k: s.uuid if s.position_count == 1 else new_uuid() for k in found}
            series = [file_entry(s, k, uuids[k], found[k]) for k in sorted(found)]
            for k in found:
                path = s.tiff_path(k)
                if not files.is_local(path):
                    raise PlaneFrameError("OME-TIFF output needs a file system with in-place writes")
                patch_description(files.local(path), ome_xml(s, series, uuids[k]).encode())

    def abort(self, messages) -> None:
        """A job that began the output removes it. One that added to it leaves it: files move into place whole, shards beyond the array document's
        shape are not read, and the job that comes again replaces them."""
        if not self.grown:
            for path in targets(Settings.from_json(self.settings)):
                files.remove(path)


class PlaneSource(DataSource):
    """The writing side of the format name ``planeframe``; reading is added in ``readers``."""

    @classmethod
    def name(cls) -> str:
        return "planeframe"

    def writer(self, schema, overwrite: bool):
        return PlaneWriter(self.options["settings"])

    def schema(self):
        from .readers import SCHEMA

        return SCHEMA

    def reader(self, schema):
        from .readers import PlaneReader

        return PlaneReader(self.options)
