"""Pixel layout: sizes, strides, strips, colours and display windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP_BYTES = 65536


def bytes_per_pixel(pixel_type: Column) -> Column:
    return F.when(pixel_type == "uint8", 1).when(pixel_type == "uint16", 2)


def storage_bits(pixel_type: Column) -> Column:
    return bytes_per_pixel(pixel_type) * 8


def pixel_format_name(pixel_type: Column) -> Column:
    return F.when(pixel_type == "uint8", "Mono8").when(pixel_type == "uint16", "Mono16")


def pixel_format_id(pixel_type: Column) -> Column:
    return F.when(pixel_type == "uint8", 0).when(pixel_type == "uint16", 1)


def packed_row_bytes(width: Column, pixel_type: Column) -> Column:
    return width.cast("long") * bytes_per_pixel(pixel_type)


def frame_stride(stride: Column, width: Column, pixel_type: Column) -> Column:
    """The given stride, or the packed row where it is 0."""
    return F.coalesce(F.nullif(stride.cast("long"), F.lit(0)), packed_row_bytes(width, pixel_type))


def rows_per_strip(row_bytes: Column, height: Column) -> Column:
    return F.least(F.greatest(F.call_function("div", F.lit(STRIP_BYTES).cast("long"), row_bytes.cast("long")), F.lit(1)), height.cast("long"))


def strips(row_bytes: Column, height: Column) -> Column:
    """array<struct<first_row, rows>> of a plane's strips; the last may be short."""
    return F.transform(strip_starts(row_bytes, height), lambda r: F.struct(r.alias("first_row"), strip_rows(r, row_bytes, height).alias("rows")))


def strip_starts(row_bytes: Column, height: Column) -> Column:
    """The first row of each strip of a plane."""
    return F.sequence(F.lit(0).cast("long"), height.cast("long") - 1, rows_per_strip(row_bytes, height))


def strip_rows(first_row: Column, row_bytes: Column, height: Column) -> Column:
    """The number of rows in the strip that begins with ``first_row``."""
    return F.least(rows_per_strip(row_bytes, height), height.cast("long") - first_row)


def strip_table(planes: DataFrame, row_bytes: str, height: str) -> DataFrame:
    """A row for each strip of each plane, with first_row and rows added. A plane has hundreds of strips, so planes are dealt over all cores
    before they are cut: a narrow table of very many planes may be one file and one task."""
    n = 4 * planes.sparkSession.sparkContext.defaultParallelism
    cut = planes.repartition(n).withColumn("first_row", F.explode(strip_starts(F.col(row_bytes), F.col(height))))
    return cut.withColumn("rows", strip_rows(F.col("first_row"), F.col(row_bytes), F.col(height)))


def destrided(values: Column, stride: Column, row: Column) -> Column:
    """An array of samples with rows of ``stride`` elements -> its first ``row`` elements of each row."""
    return F.filter(values, lambda v, i: i % stride < row)


def xml_color(rgb: Column) -> Column:
    """24-bit RGB -> RGBA with full alpha as a signed 32-bit integer."""
    rgba = F.shiftleft(rgb.cast("long").bitwiseAND(0xFFFFFF), 8).bitwiseOR(F.lit(0xFF).cast("long"))
    return F.when(rgba >= 2**31, rgba - 2**32).otherwise(rgba)


def hex_color(rgb: Column) -> Column:
    """24-bit RGB as six upper-case hex digits, white where there is none."""
    return F.coalesce(F.lpad(F.hex(rgb.cast("long").bitwiseAND(0xFFFFFF)), 6, "0"), F.lit("FFFFFF"))


def window_end(significant_bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), significant_bits.cast("int")) - 1
