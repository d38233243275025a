"""Shard files: encoded chunks, then an index of little-endian (offset, length) pairs and its CRC-32C; all ones mark a chunk that is not there."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

from ..model import PlaneFrameError, Settings
from .crc32c import crc32c

MISSING = 2**64 - 1


@lru_cache(maxsize=16)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def encode_chunk(tile: np.ndarray, s: Settings) -> bytes:
    raw = tile.tobytes()
    return _compressor(s.compression_level).compress(raw) if s.compression else raw


def decode_chunk(raw: bytes, size: int, compressed: bool) -> bytes:
    """The chunk's bytes; anything but exactly ``size`` of them is an error."""
    try:
        out = _decompressor().decompress(raw, max_output_size=size) if compressed else raw
    except zstandard.ZstdError as e:
        raise PlaneFrameError(f"a chunk cannot be decompressed: {e}") from e
    if len(out) != size:
        raise PlaneFrameError("a chunk has the wrong size")
    return out


def build_shard(tiles: list[tuple[int, np.ndarray | None]], s: Settings) -> bytes:
    """A shard file from its slots; chunks are laid in slot order, so the same pixels give the same bytes."""
    index, out = [MISSING] * (2 * len(tiles)), []
    if len({k for k, _ in tiles}) < len(tiles):
        raise PlaneFrameError("a chunk was written twice")
    at = 0
    for k, tile in tiles:
        if tile is not None:
            out.append(encode_chunk(tile, s))
            index[2 * k], index[2 * k + 1] = at, len(out[-1])
            at += len(out[-1])
    raw = struct.pack(f"<{len(index)}Q", *index)
    return b"".join(out) + raw + struct.pack("<I", crc32c(raw))


def shard_index(raw: bytes, slots: int) -> list[tuple[int, int] | None]:
    """(offset, length) of each slot, None where nothing is stored; the check sum and every entry are verified."""
    size = 16 * slots
    if len(raw) < size + 4:
        raise PlaneFrameError("shard is too short for its index")
    index = raw[-size - 4 : -4]
    if struct.unpack("<I", raw[-4:])[0] != crc32c(index):
        raise PlaneFrameError("shard index check sum does not match")
    payload, out = len(raw) - size - 4, []
    for offset, length in np.frombuffer(index, "<u8").reshape(-1, 2).tolist():
        if offset == MISSING and length == MISSING:
            out.append(None)
        elif offset == MISSING or length == MISSING or offset + length > payload:
            raise PlaneFrameError("shard index entry is invalid")
        else:
            out.append((offset, length))
    return out


def read_shard(raw: bytes | None, slots: int, chunk: tuple[int, int], kind: np.dtype, compressed: bool) -> list[tuple[int, np.ndarray | None]]:
    """The slots of a shard file; a file that is not there has none stored."""
    if raw is None:
        return [(k, None) for k in range(slots)]
    size = chunk[0] * chunk[1] * kind.itemsize
    out: list[tuple[int, np.ndarray | None]] = []
    for k, entry in enumerate(shard_index(raw, slots)):
        out.append((k, None if entry is None else np.frombuffer(decode_chunk(raw[entry[0] : entry[0] + entry[1]], size, compressed), kind).reshape(chunk)))
    return out
