"""Planes -> shards -> chunks: the grid in SQL, pixels in numpy, and both directions.

All chunks of a shard lie in one plane, so cutting, encoding and writing a plane needs no shuffle: rows in, files out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import shard_path
from ..model import PlaneFrameError, Settings


def chunk_grid(planes: DataFrame, s: Settings) -> DataFrame:
    """Planes (t, c, z, ...) -> a row for each slot of each shard, with its place in the image; slots beyond the edge have in_image false."""
    (h, w), (ny, nx), (sy, sx), (gy, gx) = s.chunk, s.chunks, s.shard_chunks, s.shards
    slots = planes.withColumn("shard_y", F.explode(F.sequence(F.lit(0), F.lit(gy - 1)))).withColumn("shard_x", F.explode(F.sequence(F.lit(0), F.lit(gx - 1))))
    slots = slots.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.lit(sy * sx - 1))))
    local_y, local_x = F.expr(f"chunk_index div {sx}").cast("int"), F.expr(f"chunk_index % {sx}")
    slots = slots.withColumn("chunk_y", F.col("shard_y") * sy + local_y).withColumn("chunk_x", F.col("shard_x") * sx + local_x)
    slots = slots.withColumn("in_image", (F.col("chunk_y") < ny) & (F.col("chunk_x") < nx))
    slots = slots.withColumn("y0", F.col("chunk_y") * h).withColumn("x0", F.col("chunk_x") * w)
    inside = F.col("in_image")
    slots = slots.withColumn("copy_h", F.when(inside, F.least(F.lit(h), F.lit(s.height) - F.col("y0"))).otherwise(0)).withColumn("copy_w", F.when(inside, F.least(F.lit(w), F.lit(s.width) - F.col("x0"))).otherwise(0))
    return slots.withColumn("path", shard_path(*[F.col(c) for c in ("t", "c", "z", "shard_y", "shard_x")]))


def tile_of(pixels: Column, s: Settings, y0: Column, x0: Column) -> Column:
    """A plane as an array of samples -> the samples of one chunk, zero beyond the edge. For small planes and checks; numpy does the rest."""
    h, w = s.chunk
    cells = F.sequence(F.lit(0), F.lit(h * w - 1))

    def sample(k):
        y, x = y0 + F.call_function("div", k, F.lit(w)).cast("int"), x0 + k % w
        return F.when((y < s.height) & (x < s.width), F.element_at(pixels, (y * s.width + x + 1).cast("int"))).otherwise(0)

    return F.transform(cells, sample)


def dtype(s: Settings) -> np.dtype:
    return np.dtype("<u1" if s.pixel_type == "uint8" else "<u2")


def packed_plane(payload: bytes | None, s: Settings, stride: int = 0) -> np.ndarray:
    """A payload with row padding -> (height, width) samples; no payload is a zero plane."""
    if payload is None:
        return np.zeros((s.height, s.width), dtype(s))
    step = stride or s.row_bytes
    if step < s.row_bytes or len(payload) != step * s.height:
        raise PlaneFrameError("frame payload does not match its stride and dimensions")
    rows = np.frombuffer(payload, np.uint8).reshape(s.height, step)[:, : s.row_bytes]
    return np.ascontiguousarray(rows).view(dtype(s))


def shard_tiles(plane: np.ndarray, s: Settings) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray | None]]]]:
    """(shard_y, shard_x, [(chunk_index, samples or None)]) of a plane; None marks chunks beyond the edge or without a non-zero sample."""
    (h, w), (sy, sx), (gy, gx) = s.chunk, s.shard_chunks, s.shards
    rows, columns = sy * h, gx * sx * w
    for shard_y in range(gy):
        band = plane[shard_y * rows : (shard_y + 1) * rows]
        if band.shape != (rows, columns):
            whole = np.zeros((rows, columns), plane.dtype)
            whole[: band.shape[0], : band.shape[1]] = band
            band = whole
        cut = np.ascontiguousarray(band.reshape(sy, h, gx, sx, w).transpose(2, 0, 3, 1, 4)).reshape(gx, sy * sx, h, w)
        for shard_x, (parts, full) in enumerate(zip(cut, cut.any(axis=(2, 3)).tolist())):
            yield shard_y, shard_x, [(k, parts[k] if x else None) for k, x in enumerate(full)]


def paste_tiles(s: Settings, parts: list[tuple[int, int, list[tuple[int, np.ndarray | None]]]]) -> np.ndarray:
    """The inverse of shard_tiles."""
    (h, w), (sy, sx) = s.chunk, s.shard_chunks
    out = np.zeros((s.height, s.width), dtype(s))
    for shard_y, shard_x, tiles in parts:
        for k, tile in tiles:
            if tile is not None:
                y, x = (shard_y * sy + k // sx) * h, (shard_x * sx + k % sx) * w
                view = out[y : y + h, x : x + w]
                view[:] = tile[: view.shape[0], : view.shape[1]]
    return out
