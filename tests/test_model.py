import math
from dataclasses import replace

import pytest

from planeframe.model import Channel, Detector, PlaneFrameError, Position, Settings, new_uuid, valid_uuid

OK = Settings(output_path="x", width=2, height=2, pixel_type="uint8", significant_bits=8)


@pytest.mark.parametrize(
    "change, message",
    [
        ({"output_path": ""}, "Output path"),
        ({"format": "binary"}, "frame metadata path"),
        ({"format": "binary", "frame_metadata_path": "x"}, "differs"),
        ({"uuid": "not-a-uuid"}, "UUID"),
        ({"width": 0}, "dimensions must be positive"),
        ({"width": 2**40, "height": 2**40}, "exceed the supported frame size"),
        ({"significant_bits": 9}, "Significant bits"),
        ({"z_count": 0}, "counts must be positive"),
        ({"time_count": -1}, "counts must be positive"),
        ({"acquisition_order": "TCC"}, "Acquisition order"),
        ({"acquisition_order": "CTZ"}, "unbounded T"),
        ({"channels": (Channel("a"),), "channel_count": 2}, "match their counts"),
        ({"channels": (Channel("a", excitation_nm=0.0),)}, "wavelengths"),
        ({"channels": (Channel("Same"), Channel("Same")), "channel_count": 2}, "unique"),
        ({"physical_size_x_um": math.nan}, "Physical sizes"),
        ({"detector": Detector(offset=math.inf)}, "Physical sizes"),
        ({"positions": (Position("P", grid_row=1),)}, "Position metadata"),
        ({"positions": (Position("a/b"), Position("c")), "position_count": 2}, "path components"),
        ({"positions": (Position("a"), Position("a")), "position_count": 2}, "path components"),
        ({"metadata": {"": {"a": "b"}}}, "namespaces"),
        ({"compression_level": 10}, "Compression level"),
        ({"format": "ome-zarr", "chunk_width": 0}, "chunk and shard"),
        ({"format": "ome-zarr", "max_queued_frame_bytes": 3}, "queued frame byte limit"),
        ({"format": "ome-zarr", "worker_count": 2**31}, "worker count"),
        ({"time_count": 2**40, "channel_count": 2**20, "z_count": 2**10}, "plane count"),
    ],
)
def test_rules(change, message):
    with pytest.raises(PlaneFrameError, match=message):
        replace(OK, **change).opened()


def test_defaults_and_transport():
    s = replace(OK, significant_bits=0, channels=(Channel("a", color_rgb=5),), positions=(Position("p", 1, 2, 0.5),), detector=Detector("m"), metadata={"n": {"k": "v"}}).opened()
    assert s.significant_bits == 8 and valid_uuid(s.uuid)
    assert Settings.from_json(s.to_json()) == s
    assert valid_uuid(new_uuid()) and not valid_uuid("urn:uuid:" + "g" * 36)


def test_grid_and_names():
    s = replace(OK, width=5, height=5, chunk_width=2, chunk_height=2, shard_width_chunks=1, shard_height_chunks=1)
    assert (s.chunk, s.chunks, s.shard_chunks, s.shards) == ((2, 2), (3, 3), (1, 1), (3, 3))
    assert replace(s, shard_width_chunks=0, shard_height_chunks=0).shards == (1, 1)
    two = replace(OK, position_count=2, output_path="d/run.OME.TIF", positions=(Position("A", 1, 2), Position("B")))
    assert [two.series_name(k) for k in (0, 1)] == ["A_1_2", "B"]
    assert two.tiff_path(1) == "d/run/run_p001.ome.tiff" and two.tiff_path(1234).endswith("_p1234.ome.tiff")
    assert two.image_title(1) == "Image B" and two.channel_name(0) == "Channel 1"
    assert replace(OK, width=512, height=256, pixel_type="uint16").rows_per_strip == 64
