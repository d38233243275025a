"""What a finished dataset says about its series: sizes, plane lists, stage labels, annotations, payload offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Settings


def series_sizes(planes: DataFrame, s: Settings) -> DataFrame:
    """(position_index, planes, size_t, size_t_grown) of every position with a plane, fills included.

    size_t, of TIFF series, is the configured number of times or more; size_t_grown, of Zarr arrays, is what the planes reach.
    """
    reach = F.max("t") + 1
    return planes.groupBy("position_index").agg(F.count("*").alias("planes"), F.greatest(F.lit(s.time_count or 1).cast("long"), reach).alias("size_t"), F.coalesce(reach, F.lit(0)).alias("size_t_grown"))


def stage_labels(planes: DataFrame, s: Settings) -> DataFrame:
    """(position_index, x_um, y_um, z_um): each axis of the configured position, else of the first plane (by ifd) that has any."""
    some = F.col("stage.x_um").isNotNull() | F.col("stage.y_um").isNotNull() | F.col("stage.z_um").isNotNull()
    first = planes.groupBy("position_index").agg(F.min_by(F.when(some, F.col("stage")), F.when(some, F.col("ifd"))).alias("first"))
    if not s.positions:
        return first.select("position_index", *[F.col(f"first.{a}").alias(a) for a in ("x_um", "y_um", "z_um")])
    rows = [(i, p.x_um, p.y_um, p.z_um) for i, p in enumerate(s.positions)]
    known = planes.sparkSession.createDataFrame(rows, "position_index int, kx double, ky double, kz double")
    joined = first.join(F.broadcast(known), "position_index", "left")  # one row a configured position
    return joined.select("position_index", *[F.coalesce(F.col(k), F.col(f"first.{a}")).alias(a) for k, a in zip(("kx", "ky", "kz"), ("x_um", "y_um", "z_um"))])


def has_annotations(planes: DataFrame) -> DataFrame:
    return planes.groupBy("position_index").agg(F.coalesce(F.bool_or(F.size("metadata") > 0), F.lit(False)).alias("annotated"))


def payload_offsets(index: DataFrame, order: tuple[str, ...] = ("seq",), key: tuple[str, ...] = ()) -> DataFrame:
    """Adds payload_offset: the bytes of all earlier payloads of the same file."""
    earlier = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("payload_offset", F.coalesce(F.sum("payload_bytes").over(earlier), F.lit(0)))
