"""Validation, coordinate assignment, duplicate rejection and gap fill of frames, as column expressions and window scans.

With n the next plane index of a position, an explicit frame of plane p is rejected if p < n and else sets n to p + 1; an automatic
frame takes n and adds one. This is a scan over (max, +): with A the running number of automatic frames and M the running maximum of
``p + 1 - A`` over explicit ones (0 at least), n after a frame is A + M. Rejected frames never raise M, and with a
capacity everything after it is full is rejected in both forms, so no state is needed.

The scan is associative. Given ``bucket``, an expression that never falls along the order (a day, an hour, a range of seq),
each bucket is scanned on its own and shifted by what the buckets before it add up to, so one position's frames use many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Settings

OUTSIDE = "frame coordinates are outside the configured dataset"
LAYOUT = "frame payload does not match its stride and dimensions"
METADATA = "frame metadata holds an invalid value"
FULL = "dataset contains all configured frames"
LATE = "frame is duplicate or out of acquisition order"


def plane_index(s: Settings, t: Column, c: Column, z: Column) -> Column:
    """Coordinates -> plane index: mixed radix in acquisition order, outermost axis first. Overflow raises in ANSI mode."""
    at = {"T": t.cast("long"), "C": c.cast("long"), "Z": z.cast("long")}
    index = at[s.acquisition_order[0]]
    for axis in s.acquisition_order[1:]:
        index = index * F.lit(s.counts[axis]).cast("long") + at[axis]
    return index


def plane_coordinates(s: Settings, index: Column) -> dict[str, Column]:
    """Plane index -> {"t", "c", "z"}: the innermost axis first, the outermost takes the rest."""
    out = {}
    rest = index.cast("long")
    for axis in reversed(s.acquisition_order[1:]):
        n = F.lit(s.counts[axis]).cast("long")
        out[axis.lower()] = rest % n
        rest = F.call_function("div", rest, n)
    out[s.acquisition_order[0].lower()] = rest
    return {"t": out["t"].cast("long"), "c": out["c"].cast("int"), "z": out["z"].cast("int")}


def layout_ok(s: Settings, byte_count: Column, stride: Column) -> Column:
    """The payload has ``stride`` bytes (0: packed) for each row and a row fits in them."""
    step = F.coalesce(F.nullif(stride.cast("long"), F.lit(0)), F.lit(s.row_bytes).cast("long"))
    return F.coalesce((step >= s.row_bytes) & (byte_count.cast("long") == step * s.height), F.lit(False))


def coordinates_ok(s: Settings, position: Column, t: Column, c: Column, z: Column) -> Column:
    """All axes inside; a null t or -1 asks for the next plane."""
    ok = position.between(0, s.position_count - 1) & c.between(0, s.channel_count - 1) & z.between(0, s.z_count - 1)
    time = F.coalesce(t.cast("long"), F.lit(-1)) >= -1
    if s.time_count:
        time = time & (F.coalesce(t.cast("long"), F.lit(-1)) < s.time_count)
    return F.coalesce(ok, F.lit(False)) & time


def _finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(True))


def metadata_ok(exposure: Column, stage: Column, metadata: Column) -> Column:
    """Exposure finite and not negative, stage values finite where there are any, no empty key."""
    ok = _finite(exposure) & F.coalesce(exposure >= 0, F.lit(True))
    for axis in ("x_um", "y_um", "z_um"):
        ok = ok & _finite(stage.getField(axis))
    return ok & ~F.coalesce(F.exists(F.map_keys(metadata), lambda k: k == ""), F.lit(False))


def validated(df: DataFrame, s: Settings, layout: bool = True, coordinates: bool = True) -> DataFrame:
    """Frames with ``reason``, null for valid ones; the first failing rule wins. Binary output checks the layout only."""
    reason = F.lit(None).cast("string")
    if coordinates:
        reason = F.when(~metadata_ok(F.col("exposure_ms"), F.col("stage"), F.col("metadata")), METADATA)
        reason = F.when(~coordinates_ok(s, *(F.col(c) for c in ("position_index", "t", "c", "z"))), OUTSIDE).otherwise(reason)
    if layout:
        reason = F.when(~layout_ok(s, F.octet_length("bytes"), F.col("stride")), LAYOUT).otherwise(reason)
    return df.withColumn("reason", reason)


def admitted(df: DataFrame, s: Settings, order: tuple[str, ...] = ("seq",), bucket: Column | None = None, start: dict[int, int] | None = None) -> DataFrame:
    """Valid frames (position_index, order columns, t, c, z, ...) -> the same with plane_index, next_before, accepted and reason.

    Accepted automatic frames get the coordinates of their plane. The order must be total within a position. ``start`` has the
    next plane index of positions that have planes already, as a stream's earlier batches leave it.
    """
    floor = F.lit(0).cast("long")
    if start:  # one row a position, so a join and not a branch for each of them
        state = df.sparkSession.createDataFrame(list(start.items()), "_position int, _floor long")
        df = df.join(state, F.col("position_index") == F.col("_position"), "left").drop("_position")
        floor = F.coalesce("_floor", F.lit(0).cast("long"))
    auto = F.col("t").isNull()
    one = F.when(auto, F.lit(1).cast("long")).otherwise(0)
    df = df.withColumn("_plane", F.when(~auto, plane_index(s, F.col("t"), F.col("c"), F.col("z"))))
    keys = ["position_index"]
    if bucket is not None:
        df, keys = df.withColumn("_bucket", bucket), ["position_index", "_bucket"]
    upto = Window.partitionBy(*keys).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_a", F.sum(one).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_m", F.col("_plane") + 1 - F.col("_a"))
    df = df.withColumn("_a0", F.coalesce(F.sum(one).over(before), F.lit(0))).withColumn("_m0", F.max("_m").over(before))
    if bucket is None:
        start_a, start_m = F.lit(0).cast("long"), floor
    else:
        sums = df.groupBy(*keys).agg(F.sum(one).alias("_n"), F.max("_m").alias("_top"))
        earlier = Window.partitionBy("position_index").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_start_a", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_shifted", F.col("_top") - F.col("_start_a"))
        sums = sums.withColumn("_start_m", F.greatest(F.coalesce(F.max("_shifted").over(earlier), F.lit(0)), F.lit(0)))
        df = df.join(sums.select(*keys, "_start_a", "_start_m"), keys)
        start_a, start_m = F.col("_start_a"), F.col("_start_m")
    # inside a bucket p + 1 - A counts the bucket's own automatic frames; the global value is lower by those before it
    m = F.greatest(start_m, F.coalesce(F.col("_m0") - start_a, F.lit(0)), floor)
    df = df.withColumn("next_before", start_a + F.col("_a0") + m)
    df = df.withColumn("plane_index", F.coalesce("_plane", "next_before"))
    cap = s.capacity
    full = F.lit(False) if cap is None else F.col("next_before") >= cap
    df = df.withColumn("reason", F.when(auto & full, FULL).when(~auto & (F.col("_plane") < F.col("next_before")), LATE)).withColumn("accepted", F.col("reason").isNull())
    at = plane_coordinates(s, F.col("plane_index"))
    take = auto & F.col("accepted")
    df = df.withColumns({k: F.when(take, v).otherwise(F.col(k)) for k, v in at.items()})
    return df.drop("_plane", "_a", "_m", "_a0", "_m0", "_bucket", "_start_a", "_start_m", "_floor")


def ordered(df: DataFrame, column: str = "seq", name: str = "order_bucket") -> DataFrame:
    """Adds ranges of an order column of about equally many rows each, however its values are spread. They hold for one evaluation: write the result."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, column).withColumn(name, F.spark_partition_id())


def fills(accepted: DataFrame, s: Settings, max_gap: int | None = None) -> DataFrame:
    """(position_index, plane_index, t, c, z) of every plane that accepted frames skip; ``max_gap`` is a guard that raises."""
    gap = F.col("plane_index") - F.col("next_before")
    rows = accepted.where(gap > 0)
    if max_gap is not None:
        rows = rows.withColumn("next_before", F.when(gap <= max_gap, F.col("next_before")).otherwise(F.raise_error(F.lit(f"a gap of more than {max_gap} planes"))))
    rows = rows.select("position_index", F.explode(F.sequence(F.col("next_before"), F.col("plane_index") - 1)).alias("plane_index"))
    at = plane_coordinates(s, F.col("plane_index"))
    return rows.select("position_index", "plane_index", *[at[k].alias(k) for k in ("t", "c", "z")])


def filled(accepted: DataFrame, s: Settings, max_gap: int | None = None) -> DataFrame:
    """Accepted frames and a default row with is_fill for every skipped plane."""
    real = accepted.withColumn("is_fill", F.lit(False))
    return real.unionByName(fills(accepted, s, max_gap).withColumn("is_fill", F.lit(True)), allowMissingColumns=True)


def split(df: DataFrame, s: Settings, order: tuple[str, ...] = ("seq",), bucket: Column | None = None, start: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames -> (accepted, rejected with reason): validation first, then admission of what is valid."""
    return judged(validated(df, s), s, order, bucket, start)


def judged(checked: DataFrame, s: Settings, order: tuple[str, ...] = ("seq",), bucket: Column | None = None, start: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Validated frames -> (accepted, rejected with reason)."""
    found = admitted(checked.where("reason is null").drop("reason"), s, order, bucket, start)
    rejected = checked.where("reason is not null").unionByName(found.where("not accepted").select(*checked.columns))
    return found.where("accepted").drop("reason", "accepted"), rejected


def output_index(accepted: DataFrame, order: tuple[str, ...] = ("seq",), bucket: Column | None = None) -> DataFrame:
    """Adds output_index: real frames over all positions, from 0 in arrival order. With ``bucket`` no task sees all rows."""
    if bucket is None:
        return accepted.withColumn("output_index", F.row_number().over(Window.orderBy(*order)) - 1)
    df = accepted.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1).join(counts, "_bucket")
    return df.withColumn("output_index", F.col("_before") + F.col("_k")).drop("_bucket", "_before", "_k")


def ifd_numbers(planes: DataFrame) -> DataFrame:
    """Adds ifd: the number of a plane in its series' file. Planes are gapless once filled, so it is the plane index itself."""
    return planes.withColumn("ifd", F.col("plane_index"))
