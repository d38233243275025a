"""OME-XML 2016-06 of a TIFF dataset, built from the planes that each file has."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ..functions.text import escape_xml, iso_text, number
from ..model import Settings

#: Fixed text: the schema's address and the comment that OME readers look for.
NAMESPACE = "http://www.openmicroscopy.org/Schemas/OME/2016-06"
COMMENT = "<!-- Warning: this comment is an OME-XML metadata block, which contains crucial dimensional parameters and other important metadata. Please edit cautiously. -->"
MICRON = "µm"


@dataclass
class SeriesFile:
    """One file: its position, name, UUID and planes [{ifd, t, c, z, timestamp_ns, exposure_ms, stage, metadata}] in page order."""

    position: int
    name: str
    uuid: str
    planes: list[dict] = field(default_factory=list)


def _tag(name: str, attributes: dict, body: str | None = None) -> str:
    """An element; attributes that are None are left out, doubles print in 17 digits."""
    text = "".join(f' {k}="{number(v) if isinstance(v, float) else escape_xml(str(v))}"' for k, v in attributes.items() if v is not None)
    return f"<{name}{text}/>" if body is None else f"<{name}{text}>{body}</{name}>"


def _measure(name: str, value: float | None, unit: str) -> dict:
    """A value and its unit, nothing for None."""
    return {} if value is None else {name: float(value), f"{name}Unit": unit}


def _positive(value: float) -> float | None:
    return value if value and value > 0 else None


def _map_annotation(identifier: str, namespace: str, values: dict) -> str:
    items = "".join(_tag("M", {"K": k}, escape_xml(v)) for k, v in values.items())
    return _tag("MapAnnotation", {"ID": identifier, "Namespace": namespace}, _tag("Value", {}, items))


def _stage_label(s: Settings, f: SeriesFile) -> str:
    known = s.positions[f.position] if s.positions else None
    first = next((p["stage"] for p in f.planes if p["stage"] and any(v is not None for v in p["stage"].values())), {})
    out = {"Name": s.position_name(f.position)}
    for axis in "xyz":
        value = getattr(known, f"{axis}_um", None)
        value = first.get(f"{axis}_um") if value is None else value
        if value is not None:
            out |= {axis.upper(): float(value), f"{axis.upper()}Unit": MICRON}
    return _tag("StageLabel", out)


def _channels(s: Settings, f: SeriesFile):
    for k in range(s.channel_count):
        c = s.channels[k] if s.channels else None
        out = {"ID": f"Channel:{f.position}:{k}", "Name": s.channel_name(k)}
        if c:
            out |= {"Fluor": c.fluorophore or None} | _measure("ExcitationWavelength", c.excitation_nm, "nm") | _measure("EmissionWavelength", c.emission_nm, "nm")
            if c.color_rgb is not None:
                rgba = (c.color_rgb & 0xFFFFFF) << 8 | 0xFF
                out["Color"] = rgba - (1 << 32) if rgba >= 1 << 31 else rgba
        yield _tag("Channel", out | {"SamplesPerPixel": 1})


def _plane(s: Settings, f: SeriesFile, p: dict) -> str:
    out = {"TheZ": p["z"], "TheC": p["c"], "TheT": p["t"]}
    start, ts = s.acquisition_start_ns, int(p["timestamp_ns"] or 0)
    if start and ts >= start:
        out |= _measure("DeltaT", (ts - start) / 1e6, "ms")
    exposure = p["exposure_ms"] if p["exposure_ms"] and p["exposure_ms"] > 0 else s.default_exposure_ms
    out |= _measure("ExposureTime", _positive(exposure), "ms")
    for axis in "xyz":
        out |= _measure(f"Position{axis.upper()}", (p["stage"] or {}).get(f"{axis}_um"), MICRON)
    return _tag("Plane", out, _tag("AnnotationRef", {"ID": f"Annotation:Plane:{f.position}:{p['ifd']}"}) if p["metadata"] else None)


def _pixels(s: Settings, f: SeriesFile, many: bool):
    size_t = max([s.time_count or 1, *(p["t"] + 1 for p in f.planes)])
    out = {"ID": f"Pixels:{f.position}", "DimensionOrder": "XYZCT", "Type": s.pixel_type, "SizeX": s.width, "SizeY": s.height, "SizeZ": s.z_count, "SizeC": s.channel_count, "SizeT": size_t, "BigEndian": "false", "Interleaved": "false"}
    for axis in "xyz":
        out |= _measure(f"PhysicalSize{axis.upper()}", _positive(getattr(s, f"physical_size_{axis}_um")), MICRON)
    out |= _measure("TimeIncrement", _positive(s.time_increment_ms), "ms") | {"SignificantBits": s.significant_bits}
    body = [*_channels(s, f)]
    for p in f.planes:
        where = {"IFD": p["ifd"], "FirstZ": p["z"], "FirstC": p["c"], "FirstT": p["t"], "PlaneCount": 1}
        body.append(_tag("TiffData", where, _tag("UUID", {"FileName": f.name}, escape_xml(f.uuid)) if many else None))
    body += [_plane(s, f, p) for p in f.planes]
    return _tag("Pixels", out, "\n      " + "\n      ".join(body) + "\n    ")


def ome_xml(s: Settings, files: list[SeriesFile], uuid: str) -> str:
    """The document that the file with ``uuid`` carries; it describes all files that have planes."""
    files = [f for f in files if f.planes]
    lines = []
    if s.detector:
        d = s.detector
        detector = _tag("Detector", {"ID": "Detector:0", "Manufacturer": d.manufacturer or None, "Model": d.model or None, "SerialNumber": d.serial_number or None, "Offset": None if d.offset is None else float(d.offset)})
        lines.append(_tag("Instrument", {"ID": "Instrument:0"}, detector))
    date = iso_text(s.acquisition_start_ns)
    shared = [_tag("AnnotationRef", {"ID": f"Annotation:Global:{k}"}) for k in range(len(s.metadata))]
    if s.linked_metadata_file:
        shared.append(_tag("AnnotationRef", {"ID": "Annotation:LinkedMetadata"}))
    for f in files:
        body = [_tag("AcquisitionDate", {}, date)] if date else []
        body += [_tag("InstrumentRef", {"ID": "Instrument:0"})] if s.detector else []
        body += [_stage_label(s, f), _pixels(s, f, len(files) > 1), *shared]
        lines.append(_tag("Image", {"ID": f"Image:{f.position}", "Name": s.image_title(f.position)}, "\n    " + "\n    ".join(body) + "\n  "))
    notes = [_map_annotation(f"Annotation:Global:{k}", space, dict(sorted(values.items()))) for k, (space, values) in enumerate(sorted(s.metadata.items()))]
    if s.linked_metadata_file:
        notes.append(_map_annotation("Annotation:LinkedMetadata", f"urn:{s.vendor}:linked-metadata", {"fileName": s.linked_metadata_file, "format": "json"}))
    for f in files:
        notes += [_map_annotation(f"Annotation:Plane:{f.position}:{p['ifd']}", f"urn:{s.vendor}:frame-metadata", dict(sorted(dict(p["metadata"]).items()))) for p in f.planes if p["metadata"]]
    if notes:
        lines.append(_tag("StructuredAnnotations", {}, "\n    " + "\n    ".join(notes) + "\n  "))
    root = {"xmlns": NAMESPACE, "xmlns:xsi": "http://www.w3.org/2001/XMLSchema-instance", "xsi:schemaLocation": f"{NAMESPACE} {NAMESPACE}/ome.xsd", "Creator": s.creator, "UUID": uuid}
    body = _tag("OME", root, "\n  " + "\n  ".join(lines) + "\n")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n{COMMENT}\n{body}\n'


def file_entry(s: Settings, position: int, uuid: str, planes: list[dict]) -> SeriesFile:
    return SeriesFile(position, os.path.basename(s.tiff_path(position)), uuid, planes)
