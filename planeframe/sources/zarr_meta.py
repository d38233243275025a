"""OME-NGFF 0.5 documents on Zarr v3: groups, arrays, the private attribute and the frame lines."""

from __future__ import annotations

import json
from decimal import Decimal

from ..functions.text import iso_text
from ..model import PlaneFrameError, Settings


def _document(**body) -> bytes:
    return (json.dumps(body, ensure_ascii=False, indent=2) + "\n").encode()


def root_group() -> bytes:
    """The root of several positions."""
    return _document(zarr_format=3, node_type="group", attributes={"ome": {"version": "0.5", "bioformats2raw.layout": 3}})


def series_group(names: list[str]) -> bytes:
    return _document(zarr_format=3, node_type="group", attributes={"ome": {"version": "0.5", "series": names}})


def frames_name(s: Settings) -> str:
    return f"{s.vendor}.frames.jsonl"


def private_attribute(s: Settings, position: int) -> dict:
    """What the dataset's private attribute says of a series."""
    out = {
        "creator": s.creator, "imageName": s.image_title(position), "positionIndex": position, "significantBits": s.significant_bits,
        "frameMetadata": frames_name(s), "frameMetadataFormat": "json-lines",
    }
    if s.linked_metadata_file:
        out["linkedMetadataFile"] = s.linked_metadata_file
    if s.acquisition_start_ns:
        out |= {"acquisitionStartTimestampNs": str(s.acquisition_start_ns), "acquisitionDate": iso_text(s.acquisition_start_ns)}
    if s.detector:
        d = s.detector
        known = {"manufacturer": d.manufacturer, "model": d.model, "serialNumber": d.serial_number, "offset": d.offset}
        out["detector"] = {k: v for k, v in known.items() if v not in ("", None)}
    if s.positions:
        p = s.positions[position]
        known = {"name": p.name or s.series_name(position), "gridRow": p.grid_row, "gridColumn": p.grid_column, "xUm": p.x_um, "yUm": p.y_um, "zUm": p.z_um}
        out["position"] = {k: v for k, v in known.items() if v is not None}
    if s.metadata:
        out["metadata"] = {space: dict(sorted(values.items())) for space, values in sorted(s.metadata.items())}
    return out


def image_group(s: Settings, position: int) -> bytes:
    """Axes with units where there is a scale, scale and translation, channels with colour and display window."""
    scale = {"t": s.time_increment_ms, "c": 0.0, "z": s.physical_size_z_um, "y": s.physical_size_y_um, "x": s.physical_size_x_um}
    kinds = {"t": ("time", "millisecond"), "c": ("channel", None), "z": ("space", "micrometer"), "y": ("space", "micrometer"), "x": ("space", "micrometer")}
    axes = [{"name": a, "type": kinds[a][0]} | ({"unit": kinds[a][1]} if scale[a] > 0 and kinds[a][1] else {}) for a in "tczyx"]
    transforms: list[dict] = [{"type": "scale", "scale": [scale[a] if scale[a] > 0 else 1 for a in "tczyx"]}]
    if s.positions:
        p = s.positions[position]
        places = (p.z_um, p.y_um, p.x_um)
        if any(v is not None for v in places):
            transforms.append({"type": "translation", "translation": [0, 0, *(v if v is not None else 0 for v in places)]})
    end = (1 << s.significant_bits) - 1
    channels = []
    for k in range(s.channel_count):
        color = s.channels[k].color_rgb if s.channels else None
        channels.append({"label": s.channel_name(k), "color": "FFFFFF" if color is None else f"{color & 0xFFFFFF:06X}", "window": {"start": 0, "end": end, "min": 0, "max": end}})
    ome = {"version": "0.5", "name": "/", "multiscales": [{"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": transforms}]}], "omero": {"channels": channels}}
    return _document(zarr_format=3, consolidated_metadata=None, node_type="group", attributes={s.vendor: private_attribute(s, position), "ome": ome})


def array_document(s: Settings, size_t: int) -> bytes:
    (h, w), (sy, sx) = s.chunk, s.shard_chunks
    little = {"name": "bytes", "configuration": {"endian": "little"}}
    inner = [little] + ([{"name": "zstd", "configuration": {"level": s.compression_level, "checksum": False}}] if s.compression else [])
    sharding = {"chunk_shape": [1, 1, 1, h, w], "index_codecs": [little, {"name": "crc32c"}], "index_location": "end", "codecs": inner}
    return _document(
        shape=[size_t, s.channel_count, s.z_count, s.height, s.width], chunk_grid={"name": "regular", "configuration": {"chunk_shape": [1, 1, 1, sy * h, sx * w]}},
        chunk_key_encoding={"name": "default", "configuration": {"separator": "/"}}, fill_value=0, attributes={}, zarr_format=3, node_type="array", storage_transformers=[],
        data_type=s.pixel_type, dimension_names=["t", "c", "z", "y", "x"], codecs=[{"name": "sharding_indexed", "configuration": sharding}],
    )


def frame_line(s: Settings, row: dict) -> str:
    """One line for a real frame: 64-bit numbers as text, optional values only where they are known."""
    ts = int(row["timestamp_ns"])
    out = {"outputIndex": str(row["output_index"]), "t": str(row["t"]), "c": row["c"], "z": row["z"], "frameIndex": str(int(row["frame_index"])), "timestampNs": str(ts)}
    if s.acquisition_start_ns and ts >= s.acquisition_start_ns:
        out["deltaTMs"] = (ts - s.acquisition_start_ns) / 1e6
    exposure = row["exposure_ms"] if row["exposure_ms"] and row["exposure_ms"] > 0 else s.default_exposure_ms
    if exposure > 0:
        out["exposureTimeMs"] = exposure
    for key, axis in (("positionXUm", "x_um"), ("positionYUm", "y_um"), ("positionZUm", "z_um")):
        if row["stage"] and row["stage"][axis] is not None:
            out[key] = row["stage"][axis]
    if row["metadata"]:
        out["metadata"] = dict(sorted(dict(row["metadata"]).items()))
    return json.dumps(out, ensure_ascii=False, default=lambda v: int(v) if isinstance(v, Decimal) else str(v))


def parse_array(raw: bytes) -> dict:
    """What a reader needs of an array document: shape, chunk, shard, pixel type and codec; other layouts are an error."""
    d = json.loads(raw)
    shape, outer = d.get("shape", []), d.get("chunk_grid", {}).get("configuration", {}).get("chunk_shape", [])
    codecs = d.get("codecs", [])
    if d.get("data_type") not in ("uint8", "uint16") or len(shape) != 5 or len(outer) != 5 or not codecs or codecs[0].get("name") != "sharding_indexed":
        raise PlaneFrameError("array document is not a sharded five-dimensional image")
    inner = codecs[0]["configuration"]
    chunk = inner["chunk_shape"]
    if len(chunk) != 5 or chunk[:3] != [1, 1, 1] or outer[:3] != [1, 1, 1] or min(chunk) <= 0 or outer[3] % chunk[3] or outer[4] % chunk[4] or min(shape[1:]) <= 0 or shape[0] < 0:
        raise PlaneFrameError("array document has unsupported chunk dimensions")
    return {"shape": shape, "chunk": (chunk[3], chunk[4]), "shard_chunks": (outer[3] // chunk[3], outer[4] // chunk[4]), "pixel_type": d["data_type"], "compressed": any(c.get("name") == "zstd" for c in inner.get("codecs", []))}
