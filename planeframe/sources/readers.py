"""Reading frames: the reading side of the format name ``planeframe``.

Options: ``path``; ``kind`` (ome-zarr, tiff or binary; OME-TIFF reads as tiff); ``index`` with the CSV of a binary file; ``pixels`` false
leaves the pixels out; ``only`` has wanted values of position_index, t, c, z and frame_number as JSON: a number, a list, or {"range": [from, to]}. They choose files,
pages or byte ranges before anything is decoded.

Filters are not pushed down by Spark itself (``pushFilters``): Spark 4.1 keeps what was pushed last with the relation, so of two queries over one
DataFrame, or two branches of one query, one would read the other's files.
"""

from __future__ import annotations

import io
import json
import os
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSourceReader, InputPartition

from ..functions.text import csv_fields
from ..model import PIXEL_FORMATS, PlaneFrameError
from . import files, zarr_meta
from .shards import read_shard
from .tiff_codec import DESCRIPTION, PageReader
from .writers import INDEX_HEADER

SCHEMA = (
    "position_index int, frame_number long, t long, c int, z int, camera_id string, frame_index decimal(20,0), timestamp_ns decimal(20,0), width int, height int, "
    "pixel_type string, significant_bits int, stride long, source_roi struct<x:int,y:int,width:int,height:int>, bytes binary"
)
KEYS = ("position_index", "t", "c", "z", "frame_number")
PAGES_A_TASK = 64
TASKS, BYTES_A_TASK = 256, 1 << 26


def pages_a_task(pages: int, size: int) -> int:
    """64 pages of ``size`` bytes, more where there are very many small ones: beyond some hundred tasks their start takes longer than their pages."""
    return max(PAGES_A_TASK, min(-(-pages // TASKS), BYTES_A_TASK // max(1, size)))


def tests_of(only: dict) -> list:
    """Wanted values of keys (a number, a range, or numbers) as tests [(key, sign, value)]."""
    out = []
    for key, value in only.items():
        if key not in KEYS:
            raise ValueError(f"frames are chosen by {', '.join(KEYS)}, not by {key}")
        if isinstance(value, range) and value.step == 1:
            out += [(key, ">=", value.start), (key, "<", value.stop)]
        else:
            out.append((key, "in", [int(value)] if isinstance(value, int) else sorted(map(int, value))))
    return out


def passes(tests: list, **at) -> bool:
    """Whether values of keys pass all tests; keys that are not given pass."""
    return all(at[key] in value if sign == "in" else at[key] >= value if sign == ">=" else at[key] < value for key, sign, value in tests if key in at)


def reach(tests: list, key: str, stop: int) -> tuple[int, int]:
    """The first value of a key that may pass and the one after the last, within 0 and stop."""
    first = 0
    for k, sign, value in tests:
        if k == key:
            low, high = (value, stop) if sign == ">=" else (0, value) if sign == "<" else (min(value, default=0), max(value, default=-1) + 1)
            first, stop = max(first, low), min(stop, high)
    return first, max(first, stop)


@dataclass
class Part(InputPartition):
    kind: str
    path: str
    position: int
    start: int
    stop: int
    wanted: dict


def _row(position, number, t, c, z, width, height, kind, bits, raw, camera="", index=None, ts=0, stride=None, roi=None):
    from decimal import Decimal

    size = 1 if kind == "uint8" else 2
    return (position, number, t, c, z, camera, Decimal(number if index is None else index), Decimal(ts), width, height, kind, bits, stride if stride is not None else width * size, roi or (0, 0, width, height), raw)


class PlaneReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"].removeprefix("ome-") if options["kind"] != "ome-zarr" else "zarr"
        self.index, self.pixels = options.get("index", ""), options.get("pixels", "true") == "true"
        self.vendor = options.get("vendor", "planeframe")
        self.tests = tests_of({k: range(*v["range"]) if isinstance(v, dict) else v for k, v in json.loads(options.get("only", "{}")).items()})
        if self.kind != "zarr" and any(k in ("t", "c", "z") for k, _, _ in self.tests):
            self.tests = [("position_index", "in", [])]  # these files do not say them

    def _keep(self, **at) -> bool:
        return passes(self.tests, **at)

    # planning -----------------------------------------------------------------
    def partitions(self):
        return {"zarr": self._zarr_parts, "tiff": self._tiff_parts, "binary": self._binary_parts}[self.kind]() or [Part(self.kind, self.path, 0, 0, 0, {})]

    def _groups(self) -> list[tuple[int, str]]:
        listing = f"{self.path}/OME/zarr.json"
        if files.exists(listing):
            names = json.loads(files.read(listing))["attributes"]["ome"]["series"]
            return [(k, f"{self.path}/{n}") for k, n in enumerate(names)]
        return [(0, self.path)]

    def _zarr_parts(self):
        """Ranges of times of each position that the filters leave; a plane is found by its path, no folder is listed."""
        out = []
        for position, group in self._groups():
            if self._keep(position_index=position):
                shape = zarr_meta.parse_array(files.read(f"{group}/0/zarr.json"))["shape"]
                times = shape[0]
                first, last = reach(self.tests, "t", times)
                step = max(1, pages_a_task((last - first) * shape[1] * shape[2], 2 * shape[3] * shape[4]) // (shape[1] * shape[2]))
                out += [Part("zarr", group, position, t, min(last, t + step), {"tests": self.tests}) for t in range(first, last, step)]
        return out

    def _tiff_files(self) -> list[tuple[int, str]]:
        if files.is_local(self.path) and os.path.isdir(files.local(self.path)):
            found = [p for p in files.walk(self.path) if re.search(r"(?i)\.tiff?$", p)]
            return [(int(m[1]) if (m := re.search(r"_p(\d+)\.ome\.tiff?$", p)) else k, p) for k, p in enumerate(found)]
        return [(0, self.path)]

    def _tiff_parts(self):
        out = []
        for position, path in self._tiff_files():
            if not self._keep(position_index=position):
                continue
            first, last = reach(self.tests, "frame_number", 1 << 62)
            with files.opened(path) as f:
                reader, starts, pages = PageReader(f), [], 0
                for _ in reader.directories() if first < last else ():
                    if pages >= first and (pages - first) % PAGES_A_TASK == 0:
                        starts.append((pages, reader.at))
                    pages += 1
                    if pages >= last:
                        break
            out += [Part("tiff", path, position, k, min(pages, k + PAGES_A_TASK), {"at": at, "tests": self.tests}) for k, at in starts]
        return out

    def _binary_parts(self):
        """Ranges of records; the index is read once here, the payload is only sought where a record is wanted."""
        offset, chosen = 0, []
        for k, fields in enumerate(index_records(files.read(self.index).decode())):
            size = payload_size(fields)
            if self._keep(frame_number=k, position_index=0):
                chosen.append((k, offset, fields))
            offset += size
        step = pages_a_task(len(chosen), max((payload_size(fields) for _, _, fields in chosen), default=0))
        return [Part("binary", self.path, 0, 0, 1, {"records": chosen[k : k + step]}) for k in range(0, len(chosen), step)]

    # tasks --------------------------------------------------------------------
    def read(self, part: Part):
        if part.start == part.stop:
            return iter(())
        return {"zarr": self._zarr, "tiff": self._tiff, "binary": self._binary}[part.kind](part)

    def _zarr(self, part: Part):
        array = zarr_meta.parse_array(files.read(f"{part.path}/0/zarr.json"))
        custom = json.loads(files.read(f"{part.path}/zarr.json")).get("attributes", {}).get(self.vendor, {})
        bits = custom.get("significantBits", 8 if array["pixel_type"] == "uint8" else 16)
        _, c_count, z_count, height, width = array["shape"]
        chosen = [(t, c, z) for t in range(part.start, part.stop) for c in range(c_count) for z in range(z_count)]
        for t, c, z in chosen:
            number = (t * c_count + c) * z_count + z
            if passes(part.wanted["tests"], t=t, c=c, z=z, frame_number=number):
                raw = zarr_plane(part.path, array, t, c, z).tobytes() if self.pixels else None
                yield _row(part.position, number, t, c, z, width, height, array["pixel_type"], bits, raw)

    def _tiff(self, part: Part):
        with files.opened(part.path) as f:
            reader = PageReader(f)
            text = (reader.values(next(reader.directories()), DESCRIPTION) or b"").decode("utf-8", "replace")
            m = re.search(r'SignificantBits="(\d+)"', text) if "<OME" in text else None
            for k, fields in enumerate(reader.directories(part.wanted["at"]), part.start):
                if k >= part.stop:
                    break
                if not passes(part.wanted["tests"], frame_number=k):
                    continue
                yield self._page(part, reader, fields, k, int(m[1]) if m else None)

    def _page(self, part: Part, reader: PageReader, fields: dict, k: int, bits: int | None):
        width, height, storage = reader.geometry(fields)
        kind = "uint8" if storage == 8 else "uint16"
        raw = reader.plane(fields).tobytes() if self.pixels else None
        note = plain_description((reader.values(fields, DESCRIPTION) or b"").decode("utf-8", "replace"), self.vendor)
        bits = note.get("bits_per_sample", bits or storage)
        roi = tuple(note.get(f"source_roi_{a}", d) for a, d in (("x", 0), ("y", 0), ("width", width), ("height", height)))
        return _row(part.position, k, None, None, None, width, height, kind, bits, raw, note.get("camera_id", ""), note.get("frame_index", k), note.get("timestamp_ns", 0), roi=roi)

    def _binary(self, part: Part):
        with files.opened(part.path) as f:
            for number, offset, fields in part.wanted["records"]:
                x = checked_record(fields)
                raw = None
                if self.pixels:
                    f.seek(offset)
                    raw = f.read(x["payload_bytes"])
                    if len(raw) != x["payload_bytes"]:
                        raise PlaneFrameError("binary payload is cut off")
                kind = "uint8" if x["pixel_format_id"] == 0 else "uint16"
                roi = tuple(x[f"source_roi_{a}"] for a in ("x", "y", "width", "height"))
                yield _row(0, number, None, None, None, x["width"], x["height"], kind, x["bits_per_sample"], raw, x["camera_id"], x["frame_index"], x["timestamp_ns"], x["stride"], roi)


def zarr_plane(group: str, array: dict, t: int, c: int, z: int) -> np.ndarray:
    """One plane from its shard files; files and chunks that are not there are zeros."""
    _, _, _, height, width = array["shape"]
    (h, w), (sy, sx) = array["chunk"], array["shard_chunks"]
    kind = np.dtype("<u1" if array["pixel_type"] == "uint8" else "<u2")
    out = np.zeros((height, width), kind)
    for y in range(-(-height // (h * sy))):
        for x in range(-(-width // (w * sx))):
            raw = files.read_or_none(f"{group}/0/c/{t}/{c}/{z}/{y}/{x}")
            for k, tile in read_shard(raw, sy * sx, (h, w), kind, array["compressed"]):
                top, left = (y * sy + k // sx) * h, (x * sx + k % sx) * w
                if tile is not None and top < height and left < width:
                    view = out[top : top + h, left : left + w]
                    view[:] = tile[: view.shape[0], : view.shape[1]]
    return out


def plain_description(text: str, vendor: str) -> dict:
    """The values of a plain page's JSON description, empty if it is not one of this schema."""
    try:
        note = json.loads(text)
    except ValueError:
        return {}
    if not isinstance(note, dict) or note.get("schema") != f"{vendor}.frame-metadata.v1":
        return {}
    return {k: int(v) if k not in ("schema", "linked_metadata_file", "camera_id", "pixel_format") else v for k, v in note.items()}


def index_records(text: str):
    """Field lists of a binary index after its exact header; blank lines are skipped, quoted fields may span lines."""
    lines = io.StringIO(text, newline="").read().replace("\r\n", "\n").split("\n")
    if not lines or lines[0] != INDEX_HEADER:
        raise PlaneFrameError("binary index has a wrong header")
    held = None
    for line in lines[1:]:
        held = line if held is None else held + "\n" + line
        if not held:
            held = None
            continue
        fields = csv_fields(held)
        if fields is not None:
            held = None
            yield fields
    if held:
        raise PlaneFrameError("binary index ends inside a quoted field")


def payload_size(fields: list[str]) -> int:
    if len(fields) != 14 or not re.fullmatch(r"[0-9]+", fields[9]):
        raise PlaneFrameError("binary index row is invalid")
    return int(fields[9])


def checked_record(fields: list[str]) -> dict:
    """A whole index row in its types; every rule of the format is checked."""
    names = INDEX_HEADER.split(",")
    try:
        x = {n: v if n in ("camera_id", "pixel_format") else int(v) for n, v in zip(names, fields, strict=True)}
    except ValueError as e:
        raise PlaneFrameError("binary index row is invalid") from e
    size = {0: 1, 1: 2}.get(x["pixel_format_id"])
    known = [name for name, number in PIXEL_FORMATS.values() if number == x["pixel_format_id"]]
    if size is None or x["pixel_format"] != known[0] or min(x["width"], x["height"]) <= 0 or not 1 <= x["bits_per_sample"] <= 8 * size or x["stride"] < x["width"] * size or x["payload_bytes"] != x["stride"] * x["height"] or min(x["frame_index"], x["timestamp_ns"]) < 0:
        raise PlaneFrameError("binary index row is inconsistent")
    return x
