"""Round trips over random geometries."""

import io

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from planeframe.functions.text import csv_field, csv_fields, escape_xml, parse_integer
from planeframe.model import Settings
from planeframe.operators import tiling
from planeframe.sources import shards, tiff_codec

GEOMETRY = st.builds(
    lambda w, h, kind, packed, cw, ch, sw, sh: Settings(output_path="x", width=w, height=h, pixel_type=kind, significant_bits=8, compression=packed, compression_level=1, chunk_width=cw, chunk_height=ch, shard_width_chunks=sw, shard_height_chunks=sh),
    st.integers(1, 40), st.integers(1, 40), st.sampled_from(["uint8", "uint16"]), st.booleans(), st.integers(1, 17), st.integers(1, 17), st.integers(0, 4), st.integers(0, 4),
)


def plane(s, seed, sparse):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256 ** tiling.dtype(s).itemsize, (s.height, s.width)).astype(tiling.dtype(s))
    return np.where(rng.random(out.shape) < 0.9, 0, out).astype(out.dtype) if sparse else out


@settings(max_examples=150, deadline=None)
@given(GEOMETRY, st.integers(0, 10**6), st.booleans())
def test_shards(s, seed, sparse):
    p = plane(s, seed, sparse)
    parts = []
    for y, x, tiles in tiling.shard_tiles(p, s):
        raw = shards.build_shard(tiles, s)
        parts.append((y, x, shards.read_shard(raw, len(tiles), s.chunk, tiling.dtype(s), s.compression)))
    assert len(parts) == s.shards[0] * s.shards[1]
    assert (tiling.paste_tiles(s, parts) == p).all()


@settings(max_examples=100, deadline=None)
@given(GEOMETRY, st.lists(st.integers(0, 10**6), min_size=1, max_size=4), st.booleans())
def test_pages(s, seeds, described):
    out = io.BytesIO()
    w = tiff_codec.PageWriter(out, s)
    planes = [plane(s, k, False) for k in seeds]
    for k, p in enumerate(planes):
        w.add(p, f"page {k} é".encode() if described or k == 0 else None)
    w.finish()
    r = tiff_codec.PageReader(out)
    got = [(r.values(x, tiff_codec.DESCRIPTION), r.plane(x)) for x in r.directories()]
    assert [g[0] for g in got] == [f"page {k} é".encode() if described or k == 0 else None for k in range(len(planes))]
    assert all((a == b).all() for a, (_, b) in zip(planes, got))


@settings(max_examples=100, deadline=None)
@given(GEOMETRY, st.integers(0, 50), st.integers(0, 10**6))
def test_strides(s, padding, seed):
    p = plane(s, seed, False)
    rows = [r.tobytes() + b"\xff" * padding for r in p]
    assert (tiling.packed_plane(b"".join(rows), s, s.row_bytes + padding) == p).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n\r é', max_size=8), min_size=1, max_size=5))
def test_csv(fields):
    line = ",".join(map(csv_field, fields))
    assert csv_fields(line) == fields


@given(st.text(max_size=20))
def test_text(x):
    from xml.sax.saxutils import unescape

    assert unescape(escape_xml(x), {"&quot;": '"', "&apos;": "'"}) == x
    assert parse_integer(x) is None or int(x) == parse_integer(x)
