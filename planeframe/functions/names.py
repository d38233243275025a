"""Names and paths of positions, channels, images and chunks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_name(position_count: Column, has_metadata: Column, index: Column, name: Column, row: Column, column: Column) -> Column:
    """Empty for one position, the number without metadata, else the name and its grid place."""
    placed = F.when(row.isNotNull() & column.isNotNull(), F.concat(name, F.lit("_"), row.cast("string"), F.lit("_"), column.cast("string"))).otherwise(name)
    return F.when(position_count == 1, "").when(~has_metadata, index.cast("string")).otherwise(placed)


def tiff_root(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.ome\.tiff?$", "")


def position_tiff_path(path: Column, index: Column) -> Column:
    """root/<root name>_pNNN.ome.tiff; more than three digits stay whole."""
    root = tiff_root(path)
    return F.concat(root, F.lit("/"), F.regexp_extract(root, r"([^/]*)$", 1), F.format_string("_p%03d.ome.tiff", index))


def position_name(name: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Position "), (index + 1).cast("string")))


def channel_name(name: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Channel "), (index + 1).cast("string")))


def image_name(image: Column, position_count: Column, position: Column) -> Column:
    return F.when(position_count == 1, image).otherwise(F.concat(image, F.lit(" "), position))


def shard_path(t: Column, c: Column, z: Column, shard_y: Column, shard_x: Column) -> Column:
    """Path of a shard under its group."""
    return F.concat_ws("/", F.lit("0"), F.lit("c"), *[x.cast("string") for x in (t, c, z, shard_y, shard_x)])
