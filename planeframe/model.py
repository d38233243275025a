"""Settings of a dataset: geometry, axes, physical scale, channels, positions, codec and chunk options."""

from __future__ import annotations

import json
import math
import os
import re
import uuid as _uuid
from dataclasses import asdict, dataclass, field, replace

FORMATS = ("ome-tiff", "ome-zarr", "tiff", "binary")
PIXEL_TYPES = {"uint8": 1, "uint16": 2}
#: Fixed names: pixel format and its id by pixel type.
PIXEL_FORMATS = {"uint8": ("Mono8", 0), "uint16": ("Mono16", 1)}
UUID = re.compile(r"urn:uuid:[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
MAX_LONG = 2**63 - 1
MAX_INT = 2**31 - 1


class PlaneFrameError(ValueError):
    """A rejected setting, frame or file."""


@dataclass(frozen=True)
class Detector:
    manufacturer: str = ""
    model: str = ""
    serial_number: str = ""
    offset: float | None = None

    def __bool__(self) -> bool:
        return bool(self.manufacturer or self.model or self.serial_number) or self.offset is not None


@dataclass(frozen=True)
class Channel:
    name: str = ""
    fluorophore: str = ""
    excitation_nm: float | None = None
    emission_nm: float | None = None
    color_rgb: int | None = None


@dataclass(frozen=True)
class Position:
    name: str = ""
    grid_row: int | None = None
    grid_column: int | None = None
    x_um: float | None = None
    y_um: float | None = None
    z_um: float | None = None


@dataclass(frozen=True)
class Settings:
    """What is fixed when a dataset is opened; ``vendor`` is the name that private schema, file and namespace names begin with."""

    output_path: str = ""
    format: str = "ome-tiff"
    frame_metadata_path: str = ""
    width: int = 0
    height: int = 0
    pixel_type: str = "uint16"
    significant_bits: int = 0
    position_count: int = 1
    time_count: int = 0
    channel_count: int = 1
    z_count: int = 1
    acquisition_order: str = "TCZ"
    physical_size_x_um: float = 0.0
    physical_size_y_um: float = 0.0
    physical_size_z_um: float = 0.0
    time_increment_ms: float = 0.0
    default_exposure_ms: float = 0.0
    acquisition_start_ns: int = 0
    creator: str = "planeframe"
    image_name: str = "Image"
    uuid: str = ""
    linked_metadata_file: str = ""
    vendor: str = "planeframe"
    detector: Detector = field(default_factory=Detector)
    channels: tuple[Channel, ...] = ()
    positions: tuple[Position, ...] = ()
    metadata: dict = field(default_factory=dict)
    overwrite: bool = False
    compression: bool = True
    compression_level: int = 6
    chunk_width: int = 512
    chunk_height: int = 512
    shard_width_chunks: int = 0
    shard_height_chunks: int = 0
    worker_count: int = 0
    max_queued_frame_bytes: int = 0

    # geometry -----------------------------------------------------------------
    @property
    def bytes_per_pixel(self) -> int:
        return PIXEL_TYPES[self.pixel_type]

    @property
    def storage_bits(self) -> int:
        return 8 * self.bytes_per_pixel

    @property
    def row_bytes(self) -> int:
        return self.width * self.bytes_per_pixel

    @property
    def frame_bytes(self) -> int:
        return self.row_bytes * self.height

    @property
    def rows_per_strip(self) -> int:
        """Rows of about 64 KiB, one at least and the image at most."""
        return min(max(65536 // self.row_bytes, 1), self.height)

    @property
    def counts(self) -> dict[str, int]:
        return {"T": self.time_count, "C": self.channel_count, "Z": self.z_count}

    @property
    def capacity(self) -> int | None:
        """Planes of a position; None if T is unbounded."""
        return None if self.time_count == 0 else self.time_count * self.channel_count * self.z_count

    # zarr grid ----------------------------------------------------------------
    @property
    def chunk(self) -> tuple[int, int]:
        return min(self.height, self.chunk_height), min(self.width, self.chunk_width)

    @property
    def chunks(self) -> tuple[int, int]:
        (h, w) = self.chunk
        return -(-self.height // h), -(-self.width // w)

    @property
    def shard_chunks(self) -> tuple[int, int]:
        return tuple(min(n, k) if k > 0 else n for n, k in zip(self.chunks, (self.shard_height_chunks, self.shard_width_chunks)))

    @property
    def shards(self) -> tuple[int, int]:
        return tuple(-(-n // k) for n, k in zip(self.chunks, self.shard_chunks))

    # names --------------------------------------------------------------------
    def position_name(self, index: int) -> str:
        return (self.positions[index].name if self.positions else "") or f"Position {index + 1}"

    def channel_name(self, index: int) -> str:
        return (self.channels[index].name if self.channels else "") or f"Channel {index + 1}"

    def image_title(self, index: int) -> str:
        return self.image_name if self.position_count == 1 else f"{self.image_name} {self.position_name(index)}"

    def series_name(self, index: int) -> str:
        """Folder of a position: none for one position, its number without metadata, else its name and grid place."""
        if self.position_count == 1:
            return ""
        if not self.positions:
            return str(index)
        p = self.positions[index]
        return p.name if p.grid_row is None or p.grid_column is None else f"{p.name}_{p.grid_row}_{p.grid_column}"

    def tiff_path(self, index: int) -> str:
        """The file of a position: the output path, or for several positions root/root_pNNN.ome.tiff."""
        if self.position_count == 1:
            return self.output_path
        root = re.sub(r"(?i)\.ome\.tiff?$", "", self.output_path)
        return f"{root}/{os.path.basename(root)}_p{index:03d}.ome.tiff"

    # checks -------------------------------------------------------------------
    def opened(self) -> "Settings":
        """These settings with defaults filled in and checked; raises PlaneFrameError with the first rule that fails."""
        s = replace(self, significant_bits=self.significant_bits or 8 * PIXEL_TYPES.get(self.pixel_type, 0))
        for message, ok in s._rules():
            if not ok:
                raise PlaneFrameError(message)
        return replace(s, uuid=s.uuid or new_uuid())

    def _rules(self):
        finite = math.isfinite
        yield "Output path is required", bool(self.output_path)
        yield f"Format must be one of {', '.join(FORMATS)}", self.format in FORMATS
        yield f"Pixel type must be one of {', '.join(PIXEL_TYPES)}", self.pixel_type in PIXEL_TYPES
        yield "Binary output needs a frame metadata path that differs from the output path", self.format != "binary" or self.frame_metadata_path not in ("", self.output_path)
        yield "UUID must be of the form urn:uuid:8-4-4-4-12", not self.uuid or valid_uuid(self.uuid)
        yield "Image dimensions must be positive", self.width > 0 and self.height > 0
        yield "Image dimensions exceed the supported frame size", self.frame_bytes <= 2 * MAX_LONG + 1
        yield "Significant bits must fit the pixel type", 1 <= self.significant_bits <= self.storage_bits
        yield "Position, channel and Z counts must be positive and the time count not negative", min(self.position_count, self.channel_count, self.z_count) > 0 and self.time_count >= 0
        yield "Acquisition order must name T, C and Z once, and an unbounded T must be first", sorted(self.acquisition_order) == ["C", "T", "Z"] and (self.time_count > 0 or self.acquisition_order[0] == "T")
        yield "Channel and position metadata must match their counts", len(self.channels) in (0, self.channel_count) and len(self.positions) in (0, self.position_count)
        waves = [w for c in self.channels for w in (c.excitation_nm, c.emission_nm) if w is not None]
        yield "Channel wavelengths must be finite and positive", all(finite(w) and w > 0 for w in waves)
        names = [c.name for c in self.channels]
        yield "Channel names must be non-empty and unique", all(names) and len(set(names)) == len(names)
        sizes = (self.physical_size_x_um, self.physical_size_y_um, self.physical_size_z_um, self.time_increment_ms, self.default_exposure_ms)
        yield "Physical sizes, timing or detector metadata hold an invalid value", all(finite(v) and v >= 0 for v in sizes) and (self.detector.offset is None or finite(self.detector.offset))
        series: set[str] = set()
        for index in range(self.position_count if self.positions or self.position_count <= 1 else 0):  # numbers are unique
            if self.positions:
                p = self.positions[index]
                places = [v for v in (p.x_um, p.y_um, p.z_um) if v is not None]
                yield "Position metadata holds an invalid value", bool(p.name) and (p.grid_row is None) == (p.grid_column is None) and all(map(finite, places))
            name = self.series_name(index)
            yield "Position series names must be unique path components", self.position_count == 1 or (name not in ("", ".", "..") and not set(name) & set("/\\") and name not in series)
            series.add(name)
        yield "Metadata namespaces and keys must not be empty", all(space and all(values) for space, values in self.metadata.items())
        yield "Compression level must be between 0 and 9", 0 <= self.compression_level <= 9
        if self.format == "ome-zarr":
            chunk, shard = (self.chunk_width, self.chunk_height), (self.shard_width_chunks, self.shard_height_chunks)
            yield "Zarr chunk and shard dimensions are invalid", min(chunk) > 0 and min(shard) >= 0 and all(c * s <= MAX_INT for c, s in zip(chunk, shard))
            yield "Zarr queued frame byte limit is smaller than one frame", self.max_queued_frame_bytes == 0 or self.max_queued_frame_bytes >= self.frame_bytes
            yield "Zarr worker count exceeds the hardware threads", self.worker_count <= max(1, os.cpu_count() or 1)
        yield "Configured dimensions exceed the supported plane count", (self.capacity or 0) <= MAX_LONG

    # transport ----------------------------------------------------------------
    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Settings":
        d = json.loads(text)
        d["detector"] = Detector(**d["detector"])
        d["channels"] = tuple(Channel(**c) for c in d["channels"])
        d["positions"] = tuple(Position(**p) for p in d["positions"])
        return Settings(**d)


def valid_uuid(text: str) -> bool:
    return UUID.fullmatch(text) is not None


def new_uuid() -> str:
    return f"urn:uuid:{_uuid.uuid4()}"
