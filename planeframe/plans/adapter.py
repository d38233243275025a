"""The driver tables as frames: events are a frame log, embeddings are 8 x 8 planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Channel, Position, Settings

HOUR = 3_600_000_000
START = 1_704_067_200_000_000  # 2024-01-01 UTC in microseconds

LOG = Settings(
    output_path="log", width=8, height=8, pixel_type="uint8", significant_bits=8, position_count=3, channel_count=4, z_count=2, acquisition_start_ns=START * 1000, default_exposure_ms=5.0,
    channels=tuple(Channel(n, color_rgb=c) for n, c in (("click", 0xFF0000), ("error", 0x00FF00), ("purchase", None), ("view", 0x0000FF))),
    positions=(Position("Alpha", x_um=1.5), Position("Beta", y_um=2.5, z_um=-3.0), Position("Gamma")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: position by user, time by the hour, channel by type; sign-ups are automatic frames. Order: (ts, event_id)."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = F.call_function("div", micros - START, F.lit(HOUR))
    channel = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3).otherwise(0)
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("position_index"), "event_id", micros.alias("us"), F.when(F.col("event_type") != "signup", hour).alias("t"), channel.alias("c"),
        (F.col("event_id") % 2).cast("int").alias("z"), (micros * 1000).alias("timestamp_ns"), hour.alias("hour"), "value", "props", "event_type",
    )


ORDER = ("us", "event_id")
#: The same in SQL.
EVENTS_SQL = f"""
ev as (select (user_id % 3)::int as position_index, event_id, epoch_us(ts) as us, (epoch_us(ts) - {START}) // {HOUR} as hour, event_type, value, props,
  case when event_type <> 'signup' then (epoch_us(ts) - {START}) // {HOUR} end as t,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'view' then 3 else 0 end as c,
  (event_id % 2)::int as z, epoch_us(ts) * 1000 as timestamp_ns from events)"""

ADMITTED_SQL = f"""{EVENTS_SQL},
p as (select *, case when t is not null then (t * 4 + c) * 2 + z end as plane,
  sum(case when t is null then 1 else 0 end) over (partition by position_index order by us, event_id rows unbounded preceding)::bigint as a from ev),
b as (select *, coalesce(lag(a) over w, 0) + greatest(0, coalesce(max(plane + 1 - a) over (w rows between unbounded preceding and 1 preceding), 0)) as next_before
  from p window w as (partition by position_index order by us, event_id)),
ad as (select position_index, event_id, us, hour, event_type, value, props, timestamp_ns, next_before::bigint as next_before, coalesce(plane, next_before)::bigint as plane_index,
  plane is null or plane >= next_before as accepted, plane is null as auto, t, c, z from b),
ok as (select *, plane_index // 8 as pt, ((plane_index // 2) % 4)::int as pc, (plane_index % 2)::int as pz from ad where accepted),
fl as (select position_index, unnest(range(next_before, plane_index)) as plane_index from ok where plane_index > next_before),
pl as (select position_index, plane_index, false as is_fill, event_id from ok union all select position_index, plane_index, true, null from fl),
pls as (select *, plane_index // 8 as t, ((plane_index // 2) % 4)::int as c, (plane_index % 2)::int as z from pl)"""


def dense() -> Column:
    """Samples of a dense plane, row by row."""
    return F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def sparse() -> Column:
    """Samples of a sparse plane: negative values are zero."""
    return F.transform("embedding", lambda x: F.greatest(F.lit(0).cast("long"), F.floor(x.cast("double") * 255)).cast("int"))


DENSE_SQL = "list_transform(embedding, lambda x: floor((x::double + 1) * 127.5)::int)"
SPARSE_SQL = "list_transform(embedding, lambda x: greatest(0, floor(x::double * 255))::int)"


def packed(samples: Column) -> Column:
    """Samples of 0..255 as bytes."""
    return F.encode(F.array_join(F.transform(samples, lambda v: F.char(v.cast("long").bitwiseAND(255))), ""), "ISO-8859-1")


def plane_frames(spark: SparkSession, sf_dir: str, samples: Column, z_count: int = 4) -> DataFrame:
    """Embeddings as frames of one position in vec_id order, coordinates assigned."""
    # packing samples is the work, and an input in one file would leave it to one task
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").repartition(2 * spark.sparkContext.defaultParallelism, "vec_id")
    return e.select(F.lit(0).alias("position_index"), F.col("vec_id").alias("seq"), F.lit(None).cast("long").alias("t"), F.col("vec_id").alias("frame_index"), (F.col("vec_id") * 1000 + START * 1000).alias("timestamp_ns"), packed(samples).alias("bytes"), F.concat(F.lit("cam, "), F.col("label").cast("string")).alias("camera_id"))


def plane_settings(path: str, kind: str, **more) -> Settings:
    return Settings(output_path=path, format=kind, width=8, height=8, pixel_type="uint8", significant_bits=8, chunk_width=3, chunk_height=3, shard_width_chunks=2, shard_height_chunks=2, compression_level=3, acquisition_start_ns=START * 1000, overwrite=True, **more)
