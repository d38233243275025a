import json
import re
import struct
from dataclasses import replace
from decimal import Decimal
from xml.dom import minidom

import numpy as np
import pytest

from planeframe import dataset
from planeframe.dataset import Location
from planeframe.functions import text
from planeframe.model import Channel, Detector, PlaneFrameError, Position, Settings
from planeframe.operators import tiling
from planeframe.sources import files, readers, shards, tiff_codec, zarr_meta
from planeframe.sources.crc32c import crc32c
from planeframe.sources.writers import INDEX_HEADER

START = 1_700_000_000_000_000_000
COLUMNS = "position_index int, seq long, t long, c int, z int, camera_id string, frame_index decimal(20,0), timestamp_ns decimal(20,0), stride long, source_roi struct<x:int,y:int,width:int,height:int>, exposure_ms double, stage struct<x_um:double,y_um:double,z_um:double>, metadata map<string,string>, bytes binary"


def frame(seq, raw, t=None, c=0, z=0, position=0, camera="", index=0, ts=0, stride=0, roi=None, exposure=0.0, stage=None, metadata=None):
    return (position, seq, t, c, z, camera, Decimal(index), Decimal(ts), stride, roi, exposure, stage, metadata, raw)


def write(spark, rows, s, **more):
    return dataset.write(spark.createDataFrame(rows, COLUMNS), s, **more)


def pages(path):
    with open(path, "rb") as f:
        r = tiff_codec.PageReader(f)
        return [(r.values(x, tiff_codec.DESCRIPTION), r.plane(x), {t: r.values(x, t) for t in x}) for x in r.directories()]


def full(n, value, dtype="<u1"):
    return np.full(n, value, dtype).tobytes()


def test_check_values():
    assert crc32c(b"123456789") == 0xE3069283
    assert text.number(0.1) == "0.10000000000000001" and text.number(12.5) == "12.5"
    assert text.csv_fields('"a, ""b""",2,,x') == ['a, "b"', "2", "", "x"] and text.csv_fields('"open') is None
    assert text.parse_integer("12") == 12 and text.parse_integer("12 ") is None
    assert text.iso_text(START + 123_999_999) == "2023-11-14T22:13:20.123Z" and text.iso_text(0) == ""
    assert set(dataset.codec_versions()) == {"tiff", "zlib", "zstd"}


def test_ome_tiff(spark, tmp_path):
    """Two times of constant planes, with timing, exposure, stage and escaped names."""
    path = str(tmp_path / "a.ome.tiff")
    s = Settings(output_path=path, width=8, height=4, significant_bits=12, acquisition_start_ns=START, image_name="Camera & channel", channels=(Channel("A<b", "Dye", 488.0, 520.5, 0x00FF00),), detector=Detector("Maker", offset=0.1), physical_size_x_um=0.1, linked_metadata_file="run.json", metadata={"space": {"k": '"v"'}})
    write(spark, [frame(0, full(32, 42, "<u2"), t=0, ts=START, stage=(1.5, None, None)), frame(1, full(32, 42, "<u2"), t=1, ts=START + 12_500_000, exposure=7.5, metadata={"b": "2", "a": "1"})], s)
    got = pages(path)
    assert len(got) == 2 and all((p == 42).all() and p.shape == (4, 8) for _, p, _ in got)
    xml = got[0][0].decode()
    for part in ('SizeT="2"', 'SignificantBits="12"', 'DeltaT="12.5"', 'DeltaTUnit="ms"', "Camera &amp; channel", 'ExposureTime="7.5"', 'X="1.5"', 'Color="16711935"', 'PhysicalSizeX="0.10000000000000001"', 'Offset="0.10000000000000001"', "<AcquisitionDate>2023-11-14T22:13:20.000Z", '<M K="a">1</M><M K="b">2</M>', "&quot;v&quot;", 'K="fileName">run.json', 'Fluor="Dye"', "Annotation:Plane:0:1"):
        assert part in xml, part
    assert minidom.parseString(got[0][0]).documentElement.tagName == "OME"
    assert "UUID FileName" not in got[0][0].decode() and got[1][0] is None
    row = dataset.frame(spark, Location("ome-tiff", path, frame_number=1))
    assert (row.significant_bits, row.pixel_type, bytes(row.bytes)) == (12, "uint16", full(32, 42, "<u2"))
    with pytest.raises(PlaneFrameError):
        dataset.frame(spark, Location("ome-tiff", path, frame_number=2))


def test_zarr_gap(spark, tmp_path):
    """A skipped time is a shard of the index only and reads as zeros."""
    path = str(tmp_path / "a.ome.zarr")
    s = Settings(output_path=path, format="ome-zarr", width=8, height=8, pixel_type="uint8", compression_level=3)
    write(spark, [frame(0, full(64, 9), index=5), frame(1, full(64, 9), t=2, ts=3)], s)
    array = json.loads(files.read(f"{path}/0/zarr.json"))
    assert array["shape"] == [3, 1, 1, 8, 8]
    raw = files.read(f"{path}/0/c/1/0/0/0/0")
    assert len(raw) == 20 and raw[:16] == b"\xff" * 16 and struct.unpack("<I", raw[16:])[0] == crc32c(raw[:16])
    lines = [json.loads(x) for x in files.read(f"{path}/planeframe.frames.jsonl").decode().splitlines()]
    assert [(x["t"], x["outputIndex"], x["frameIndex"]) for x in lines] == [("0", "0", "5"), ("2", "1", "0")]
    assert set(bytes(dataset.frame(spark, Location("ome-zarr", path, t=1)).bytes)) == {0}
    assert set(bytes(dataset.frame(spark, Location("ome-zarr", path, t=2)).bytes)) == {9}
    files.remove(f"{path}/0/c/2/0/0/0/0")
    assert set(bytes(dataset.frame(spark, Location("ome-zarr", path, t=2)).bytes)) == {0}
    (tmp_path / "a.ome.zarr/0/c/0/0/0/0/0").write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    with pytest.raises(PlaneFrameError, match="check sum"):
        dataset.frame(spark, Location("ome-zarr", path, t=0))


def test_zarr_many_chunks(spark, tmp_path):
    path = str(tmp_path / "a.ome.zarr")
    plane = np.zeros((700, 700), "<u1")
    plane[:512, :512], plane[:512, 512:], plane[512:, 512:] = 1, 2, 4
    s = Settings(output_path=path, format="ome-zarr", width=700, height=700, pixel_type="uint8", compression_level=3)
    write(spark, [frame(0, plane.tobytes())], s)
    index = shards.shard_index(files.read(f"{path}/0/c/0/0/0/0/0"), 4)
    assert [e is not None for e in index] == [True, True, False, True]
    assert bytes(dataset.frame(spark, Location("ome-zarr", path)).bytes) == plane.tobytes()


def test_zarr_shards(spark, tmp_path):
    path = str(tmp_path / "a.ome.zarr")
    s = Settings(output_path=path, format="ome-zarr", width=5, height=5, pixel_type="uint8", chunk_width=2, chunk_height=2, shard_width_chunks=1, shard_height_chunks=1)
    write(spark, [frame(0, full(25, 7))], s)
    assert len([p for p in files.walk(f"{path}/0/c")]) == 9
    (_, tile), = shards.read_shard(files.read(f"{path}/0/c/0/0/0/2/2"), 1, (2, 2), np.dtype("<u1"), True)
    assert tile.ravel().tolist() == [7, 0, 0, 0]


def test_channels_and_translation(spark, tmp_path):
    s = Settings(width=4, height=4, significant_bits=12, channel_count=2, channels=(Channel("DAPI", color_rgb=0x0000FF), Channel("FITC", color_rgb=0x00FF00)), positions=(Position("Control", 2, 3, 100.0, 200.0),))
    rows = [frame(0, full(16, 123, "<u2"), t=0, c=0, metadata={"temperatureC": "37.0"}), frame(1, full(16, 123, "<u2"), t=0, c=1)]
    write(spark, rows, replace(s, output_path=str(tmp_path / "a.ome.tiff")))
    write(spark, rows, replace(s, output_path=str(tmp_path / "a.ome.zarr"), format="ome-zarr"))
    xml = pages(tmp_path / "a.ome.tiff")[0][0].decode()
    assert 'SizeC="2"' in xml and "temperatureC" in xml and 'X="100"' in xml
    group = json.loads(files.read(f"{tmp_path}/a.ome.zarr/zarr.json"))["attributes"]
    assert group["ome"]["omero"]["channels"][1]["color"] == "00FF00"
    assert group["ome"]["multiscales"][0]["datasets"][0]["coordinateTransformations"][1]["translation"] == [0, 0, 0, 200.0, 100.0]
    assert group["planeframe"]["position"] == {"name": "Control", "gridRow": 2, "gridColumn": 3, "xUm": 100.0, "yUm": 200.0}
    assert json.loads(files.read(f"{tmp_path}/a.ome.zarr/0/zarr.json"))["shape"] == [1, 2, 1, 4, 4]


def test_other_order(spark, tmp_path):
    s = Settings(width=2, height=2, pixel_type="uint8", time_count=2, channel_count=2, z_count=2, acquisition_order="ZTC")
    rows = [frame(k, full(4, k + 1), t=t, c=c, z=z) for k, (z, t, c) in enumerate((z, t, c) for z in (0, 1) for t in (0, 1) for c in (0, 1))]
    write(spark, rows, replace(s, output_path=str(tmp_path / "a.ome.tiff")))
    write(spark, rows, replace(s, output_path=str(tmp_path / "a.ome.zarr"), format="ome-zarr"))
    assert len(pages(tmp_path / "a.ome.tiff")) == 8
    got = {(r.z, r.t, r.c): bytes(r.bytes)[0] for r in dataset.scan(spark, str(tmp_path / "a.ome.zarr"), "ome-zarr").collect()}
    assert got == {(z, t, c): 4 * z + 2 * t + c + 1 for z in (0, 1) for t in (0, 1) for c in (0, 1)}


def test_positions(spark, tmp_path):
    s = Settings(width=2, height=2, pixel_type="uint8", position_count=2, positions=(Position("Alpha"), Position("Beta")))
    rows = [frame(0, full(4, 1)), frame(1, full(4, 2), position=1)]
    write(spark, rows, replace(s, output_path=str(tmp_path / "positions.ome.tiff")))
    found = [pages(tmp_path / f"positions/positions_p00{k}.ome.tiff")[0][0].decode() for k in (0, 1)]
    ids = [re.search(r'<OME .*?UUID="([^"]*)"', x)[1] for x in found]
    assert ids[0] != ids[1] and all(i in x and "positions_p001.ome.tiff" in x and 'ID="Image:1"' in x for x in found for i in ids)
    write(spark, rows, replace(s, output_path=str(tmp_path / "p.ome.zarr"), format="ome-zarr"))
    root = json.loads(files.read(f"{tmp_path}/p.ome.zarr/zarr.json"))
    assert root["attributes"]["ome"]["bioformats2raw.layout"] == 3
    assert json.loads(files.read(f"{tmp_path}/p.ome.zarr/OME/zarr.json"))["attributes"]["ome"]["series"] == ["Alpha", "Beta"]
    got = dataset.scan(spark, str(tmp_path / "p.ome.zarr"), "ome-zarr").where("position_index = 1").collect()
    assert [bytes(r.bytes) for r in got] == [full(4, 2)]
    # only the second position: the first has no file and is not described
    write(spark, rows[1:], replace(s, output_path=str(tmp_path / "half.ome.tiff")))
    assert [p.split("/")[-1] for p in files.walk(str(tmp_path / "half"))] == ["half_p001.ome.tiff"]
    assert "Image:0" not in pages(tmp_path / "half/half_p001.ome.tiff")[0][0].decode()


def test_rejections_and_overwrite(spark, tmp_path):
    s = Settings(output_path=str(tmp_path / "v.ome.tiff"), width=2, height=2, pixel_type="uint8", time_count=1)
    rows = [frame(0, full(3, 31)), frame(1, full(4, 31)), frame(2, full(4, 31))]
    with pytest.raises(PlaneFrameError, match="payload"):
        write(spark, rows, s)
    assert not files.exists(s.output_path)
    rejected = write(spark, rows, s, strict=False)
    assert {r.seq: r.reason for r in rejected.collect()} == {0: "frame payload does not match its stride and dimensions", 2: "dataset contains all configured frames"}
    with pytest.raises(PlaneFrameError, match="exists"):
        write(spark, rows[1:2], s)
    write(spark, rows[1:2], replace(s, overwrite=True))
    z = replace(s, output_path=str(tmp_path / "v.ome.zarr"), format="ome-zarr")
    with pytest.raises(PlaneFrameError, match="duplicate"):
        write(spark, [frame(0, full(4, 1), t=0), frame(1, full(4, 1), t=0)], z)


def test_plain_tiff(spark, tmp_path):
    raw = {1: bytes(range(1, 7)), 2: np.arange(1, 7, dtype="<u2").tobytes()}
    for size, kind, packed in ((1, "uint8", False), (2, "uint16", True)):
        path = str(tmp_path / f"{kind}.tiff")
        s = Settings(output_path=path, format="tiff", width=3, height=2, pixel_type=kind, significant_bits=8 if size == 1 else 12, compression=packed)
        write(spark, [frame(k, raw[size], camera='Camera "A"', index=7 + k, ts=2**63 + k, roi=(10, 20, 3, 2)) for k in (0, 1)], s)
        got = pages(path)
        assert [p.ravel().tolist() for _, p, _ in got] == [[1, 2, 3, 4, 5, 6]] * 2
        note = json.loads(got[1][0])
        assert note["camera_id"] == 'Camera "A"' and note["frame_index"] == "8" and note["timestamp_ns"] == str(2**63 + 1) and note["pixel_format"] == ("Mono8" if size == 1 else "Mono16")
        row = dataset.frame(spark, Location("tiff", path, frame_number=1))
        assert (row.frame_index, row.timestamp_ns, row.camera_id, tuple(row.source_roi), bytes(row.bytes)) == (8, 2**63 + 1, 'Camera "A"', (10, 20, 3, 2), raw[size])


def test_binary(spark, tmp_path):
    s = Settings(output_path=str(tmp_path / "a.raw"), frame_metadata_path=str(tmp_path / "a.csv"), format="binary", width=2, height=2, significant_bits=12)
    raw = [bytes(range(12)), bytes(range(50, 62))]
    write(spark, [frame(k, raw[k], camera='Camera, "A"', index=20 + k, ts=987654320 + k, stride=6, roi=(3, 4, 2, 2), position=9, c=5) for k in (0, 1)], s)
    assert (tmp_path / "a.raw").read_bytes() == b"".join(raw)
    lines = (tmp_path / "a.csv").read_text().splitlines()
    assert lines[0] == INDEX_HEADER and lines[2] == '"Camera, ""A""",21,987654321,2,2,12,6,Mono16,1,12,3,4,2,2'
    row = dataset.frame(spark, Location("binary", s.output_path, s.frame_metadata_path, frame_number=1))
    assert (row.camera_id, row.stride, bytes(row.bytes), row.frame_index) == ('Camera, "A"', 6, raw[1], 21)
    (tmp_path / "b.csv").write_text(lines[0] + "\n\n" + lines[1] + "\r\n" + '"two\nlines",1,1,2,2,12,6,Mono16,1,12,0,0,0,0\n')
    got = dataset.scan(spark, s.output_path, "binary", str(tmp_path / "b.csv")).orderBy("frame_number").collect()
    assert [bytes(r.bytes) for r in got] == raw and got[1].camera_id == "two\nlines"
    (tmp_path / "c.csv").write_text(lines[0] + "\n" + lines[1].replace("Mono16", "Mono8") + "\n" + lines[2] + "\n")
    assert dataset.frame(spark, Location("binary", s.output_path, str(tmp_path / "c.csv"), frame_number=1)).frame_index == 21
    with pytest.raises(PlaneFrameError, match="inconsistent"):
        dataset.frame(spark, Location("binary", s.output_path, str(tmp_path / "c.csv"), frame_number=0))
    with pytest.raises(PlaneFrameError, match="header"):
        list(readers.index_records("x\n"))


def test_strided_frames(spark, tmp_path):
    """Row padding is dropped, bits default to the storage width, automatic frames keep their own metadata."""
    padded = bytes([1, 2, 90, 3, 4, 91])
    for kind in ("tiff", "ome-tiff", "ome-zarr"):
        s = Settings(output_path=str(tmp_path / f"a.{kind}"), format=kind, width=2, height=2, pixel_type="uint8")
        write(spark, [frame(0, padded, stride=3, exposure=2.5, metadata={"k": "v"})], s)
        row = dataset.scan(spark, s.output_path, kind).first()
        assert (bytes(row.bytes), row.significant_bits, row.stride) == (bytes([1, 2, 3, 4]), 8, 2)
    xml = pages(tmp_path / "a.ome-tiff")[0][0].decode()
    assert 'ExposureTime="2.5"' in xml and '<M K="k">v</M>' in xml
    line = json.loads(files.read(f"{tmp_path}/a.ome-zarr/planeframe.frames.jsonl"))
    assert line["exposureTimeMs"] == 2.5 and line["metadata"] == {"k": "v"}


def test_strips(spark, tmp_path):
    s = Settings(output_path=str(tmp_path / "a.ome.tiff"), width=512, height=256, compression=False)
    plane = np.arange(512 * 256, dtype="<u4").astype("<u2").reshape(256, 512)
    write(spark, [frame(0, plane.tobytes())], s)
    _, got, fields = pages(s.output_path)[0]
    assert len(fields[tiff_codec.STRIP_OFFSETS]) == 4 and (got == plane).all()


def test_empty(spark, tmp_path):
    for kind in ("tiff", "ome-tiff", "binary"):
        s = Settings(output_path=str(tmp_path / f"e.{kind}"), format=kind, frame_metadata_path=str(tmp_path / "e.csv"), width=2, height=2)
        write(spark, [], s)
        assert not files.exists(s.output_path)
    s = Settings(output_path=str(tmp_path / "e.zarr"), format="ome-zarr", width=2, height=2)
    write(spark, [], s)
    assert json.loads(files.read(f"{s.output_path}/0/zarr.json"))["shape"] == [0, 1, 1, 2, 2]
    assert dataset.scan(spark, s.output_path, "ome-zarr").count() == 0


def test_damaged_shards():
    s = Settings(output_path="x", width=4, height=4, pixel_type="uint8", significant_bits=8, chunk_width=2, chunk_height=2)
    plane = np.arange(16, dtype="<u1").reshape(4, 4)
    ((_, _, tiles),) = tiling.shard_tiles(plane, s)
    raw = shards.build_shard(tiles, s)
    assert (tiling.paste_tiles(s, [(0, 0, shards.read_shard(raw, 4, (2, 2), np.dtype("<u1"), True))]) == plane).all()

    def forged(index):
        body = struct.pack(f"<{len(index)}Q", *index)
        return b"abcd" + body + struct.pack("<I", crc32c(body))

    for index in ([0, 5], [2**64 - 1, 1], [0, 2**64 - 1], [4, 1]):
        with pytest.raises(PlaneFrameError, match="entry"):
            shards.shard_index(forged(index), 1)
    assert shards.shard_index(forged([0, 4]), 1) == [(0, 4)]
    with pytest.raises(PlaneFrameError, match="short"):
        shards.shard_index(b"abc", 1)
    with pytest.raises(PlaneFrameError, match="twice"):
        shards.build_shard([tiles[0], tiles[0]], s)
    for bad in (b"xx", shards.encode_chunk(np.zeros(3, "<u1"), s)):
        with pytest.raises(PlaneFrameError):
            shards.decode_chunk(bad, 4, True)


def test_foreign_files(spark, tmp_path):
    """A classic big-endian TIFF, and array documents that are not ours."""
    pixels = np.arange(6, dtype=">u2")
    entries = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 200), (277, 3, 1, 1 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 12)]
    raw = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 0)
    (tmp_path / "b.tif").write_bytes(raw.ljust(200, b"\0") + pixels.tobytes())
    row = dataset.frame(spark, Location("tiff", str(tmp_path / "b.tif")))
    assert np.frombuffer(bytes(row.bytes), "<u2").tolist() == list(range(6))
    document = json.loads(zarr_meta.array_document(Settings(width=4, height=4, pixel_type="uint8"), 1))
    assert zarr_meta.parse_array(json.dumps(document).encode())["chunk"] == (4, 4)
    for change in ({"data_type": "float32"}, {"shape": [1, 4, 4]}, {"codecs": []}):
        with pytest.raises(PlaneFrameError):
            zarr_meta.parse_array(json.dumps(document | change).encode())
    for where in (Location("tiff", ""), Location("binary", "x"), Location("tiff", str(tmp_path / "none.tif"))):
        with pytest.raises(PlaneFrameError):
            dataset.frame(spark, where)


def test_failed_write_leaves_nothing(spark, tmp_path):
    s = Settings(output_path=str(tmp_path / "f.ome.zarr"), format="ome-zarr", width=2, height=2, pixel_type="uint8").opened()
    dataset.register(spark)
    bad, _ = dataset.planned(spark.createDataFrame([frame(0, full(4, 1))], COLUMNS), s)
    from pyspark.sql import functions as F

    with pytest.raises(Exception):
        bad.withColumn("bytes", F.unhex(F.lit("00"))).write.format("planeframe").option("settings", s.to_json()).mode("append").save()
    assert not files.exists(s.output_path)


def test_pushed_filters(spark, tmp_path):
    s = Settings(output_path=str(tmp_path / "p.ome.zarr"), format="ome-zarr", width=2, height=2, pixel_type="uint8")
    write(spark, [frame(k, full(4, k + 1)) for k in range(200)], s)
    rows, some = dataset.scan(spark, s.output_path, "ome-zarr"), dataset.scan(spark, s.output_path, "ome-zarr", only={"t": 150})
    assert rows.rdd.getNumPartitions() == 4 and some.rdd.getNumPartitions() == 1
    assert bytes(some.first().bytes) == full(4, 151)
    assert dataset.scan(spark, s.output_path, "ome-zarr", pixels=False, only={"t": 3}).first().bytes is None
    with pytest.raises(ValueError):
        from planeframe.sources.readers import tests_of

        tests_of({"camera_id": 3})


def test_filters_of_one_scan_do_not_mix(spark, tmp_path):
    """Queries over one scan, and branches of one query, each see their own frames, also where Spark would push filters."""
    s = Settings(output_path=str(tmp_path / "m.zarr"), format="ome-zarr", width=2, height=2, pixel_type="uint8")
    write(spark, [frame(k, full(4, k + 1)) for k in range(100)], s)
    for push in ("false", "true"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        rows = dataset.scan(spark, s.output_path, "ome-zarr")
        a, b = rows.where("t = 5"), rows.where("t = 6")
        assert [r.t for r in a.unionAll(b).collect()] == [5, 6]
        assert (rows.where("t < 3").count(), rows.count(), a.count(), b.first().t) == (3, 100, 1, 6)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_wanted_ranges(spark, tmp_path):
    """Ranges and lists of values choose files, pages and records before anything is decoded."""
    paths = {kind: str(tmp_path / f"r.{kind}") for kind in ("ome-zarr", "tiff", "binary")}
    for kind, path in paths.items():
        s = Settings(output_path=path, format=kind, frame_metadata_path=f"{path}.csv", width=2, height=2, pixel_type="uint8")
        write(spark, [frame(k, full(4, k + 1)) for k in range(200)], s)
        key = "t" if kind == "ome-zarr" else "frame_number"
        for only, want in ((range(70, 76), range(70, 76)), ([3, 199, 500], [3, 199]), (range(198, 1000), [198, 199]), (1, [1]), (range(5, 3), []), ([], []), (-1, []), (200, [])):
            found = dataset.scan(spark, path, kind, f"{path}.csv", only={key: only})
            assert sorted(bytes(r.bytes)[0] for r in found.collect()) == [k + 1 for k in want]
            if only == range(70, 76):
                assert found.rdd.getNumPartitions() == 1 < dataset.scan(spark, path, kind, f"{path}.csv").rdd.getNumPartitions()
        assert dataset.scan(spark, path, kind, f"{path}.csv", only={"position_index": 1}).count() == 0
    assert dataset.scan(spark, paths["tiff"], "tiff", only={"t": 3}).count() == 0


def lzw(data: bytes) -> bytes:
    """Codes as the TIFF format has them, for the test of the reading side."""
    codes, table, held = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    free, width = 258, 9
    for k in data:
        if held + bytes([k]) in table:
            held += bytes([k])
            continue
        codes.append((table[held], width))
        table[held + bytes([k])] = free
        free += 1
        width = 9 + (free >= 512) + (free >= 1024) + (free >= 2048)
        if free == 4095:
            codes.append((256, 12))
            table, free, width = {bytes([j]): j for j in range(256)}, 258, 9
        held = bytes([k])
    codes += [(table[held], width)] if held else []
    codes.append((257, 9 + (free >= 511) + (free >= 1023) + (free >= 2047)))
    text = "".join(f"{c:0{w}b}" for c, w in codes)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_lzw_strips(spark, tmp_path):
    # the example of the format: 7 7 7 8 8 7 7 6 6
    known = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)).ljust(88, "0")
    assert tiff_codec._lzw(int(known, 2).to_bytes(11, "big"), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 256, 20_000), rng.integers(0, 3, 50_000), np.zeros(9_000)):
        raw = data.astype("u1").tobytes()
        assert tiff_codec._lzw(lzw(raw), len(raw)) == raw
    packed = lzw(bytes(range(6)))
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 5), (273, 4, 1, 200), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, len(packed))]
    head = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    (tmp_path / "l.tif").write_bytes(head.ljust(200, b"\0") + packed)
    assert bytes(dataset.frame(spark, Location("tiff", str(tmp_path / "l.tif"))).bytes) == bytes(range(6))
    with pytest.raises(PlaneFrameError, match="LZW"):
        tiff_codec._lzw(b"\xff\xf0", 4)


def test_times_in_any_zone(spark):
    from pyspark.sql import functions as F

    from planeframe.functions import text

    stamps = [0, 1, 1_700_000_000_123_456_789, 1_711_850_400_000_000_000, 1_711_852_200_999_999_999, 2**64 - 1]  # the fourth falls into an hour that Berlin leaves out
    rows = spark.createDataFrame([(str(x),) for x in stamps], "x string").select("x", text.iso_timestamp(F.col("x").cast("decimal(20,0)")).alias("iso"))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert {int(r.x): r.iso for r in rows.collect()} == {x: text.iso_text(x) for x in stamps}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
