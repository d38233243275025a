"""Schemas of the frames, one row for each image plane, and what is filled in where an input has fewer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROI = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
STAGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x_um", "y_um", "z_um")])

FRAME = T.StructType(
    [
        T.StructField("position_index", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("c", T.IntegerType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("camera_id", T.StringType()),
        T.StructField("frame_index", T.DecimalType(20, 0)),
        T.StructField("timestamp_ns", T.DecimalType(20, 0)),
        T.StructField("stride", T.LongType()),
        T.StructField("source_roi", ROI),
        T.StructField("exposure_ms", T.DoubleType()),
        T.StructField("stage", STAGE),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("bytes", T.BinaryType()),
    ]
)

#: What a frame has that does not say; a zero-filled plane too.
_VALUES = {"position_index": 0, "camera_id": "", "frame_index": 0, "timestamp_ns": 0, "stride": 0, "exposure_ms": 0.0, "c": 0, "z": 0}


def frames(df: DataFrame) -> DataFrame:
    """``df`` with all columns of FRAME in their types, missing ones at their defaults; t = -1 and null both mean "assign next".

    Other columns are dropped. The order column ``seq`` is required: a DataFrame has no arrival order.
    """
    if "seq" not in df.columns:
        raise ValueError("frames need an order column named seq")
    out = []
    for f in FRAME.fields:
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in _VALUES:
            col = F.coalesce(col, F.lit(_VALUES[f.name]).cast(f.dataType))
        if f.name == "t":
            col = F.when(col != -1, col)
        if f.name == "source_roi":
            col = F.coalesce(col, F.struct(*[F.lit(0).alias(n) for n in ROI.names]).cast(ROI))
        if f.name == "metadata":
            col = F.coalesce(col, F.create_map().cast(f.dataType))
        out.append(col.alias(f.name))
    return df.select(*out)
