"""All queries over the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dataset
from ..functions import layout, names, text
from ..model import PlaneFrameError, Settings
from ..operators import admission, summary, tiling
from ..sources import files, shards, tiff_codec, zarr_meta
from ..sources.readers import zarr_plane
from ..streaming.append import FrameAppender, append_stream
from ..workspace import forget, new_path, written
from .adapter import ADMITTED_SQL, DENSE_SQL, EVENTS_SQL, LOG, ORDER, SPARSE_SQL, dense, events, plane_frames, plane_settings, sparse, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str = ""):
    """Registers a query under ``name`` or its function's name, with its SQL where there is one."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


# admission -----------------------------------------------------------------------------------------------------------
def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admitted(events(spark, sf_dir), LOG, ORDER, bucket=F.col("hour"))


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.ifd_numbers(admission.filled(_judged(spark, sf_dir).where("accepted"), LOG))


@query(f"with {ADMITTED_SQL} select position_index, plane_index, is_fill, t, c, z from pls")
def gap_fill(spark, sf_dir):
    return _planes(spark, sf_dir).select("position_index", "plane_index", "is_fill", "t", "c", "z")


@query(f"""with {ADMITTED_SQL} select event_id, position_index, plane_index, next_before, accepted, case when accepted then null else '{admission.LATE}' end as reason,
  case when auto then plane_index // 8 else t end as t, case when auto then ((plane_index // 2) % 4)::int else c end as c, case when auto then (plane_index % 2)::int else z end as z from ad""")
def admit(spark, sf_dir):
    return _judged(spark, sf_dir).select("event_id", "position_index", "plane_index", "next_before", "accepted", "reason", "t", "c", "z")


@query(f"""with {EVENTS_SQL}, p as (select *, case when t is not null then (t * 4 + c) * 2 + z end as plane,
  sum(case when t is null then 1 else 0 end) over (partition by position_index order by us, event_id rows unbounded preceding)::bigint as a from ev where t is null or t < 500),
b as (select *, coalesce(lag(a) over w, 0) + greatest(0, coalesce(max(plane + 1 - a) over (w rows between unbounded preceding and 1 preceding), 0)) as n
  from p window w as (partition by position_index order by us, event_id))
select event_id, case when plane is null and n >= 4000 then '{admission.FULL}' when plane < n then '{admission.LATE}' end as reason from b
union all select event_id, '{admission.OUTSIDE}' from ev where t >= 500""")
def admit_bounded(spark, sf_dir):
    """A bounded log: frames outside are rejected before admission, and the positions become full."""
    s = replace(LOG, time_count=500)
    rows = events(spark, sf_dir)
    inside = admission.coordinates_ok(s, *(F.col(c) for c in ("position_index", "t", "c", "z")))
    judged = admission.admitted(rows.where(inside), s, ORDER, bucket=F.col("hour")).select("event_id", "reason")
    return judged.unionByName(rows.where(~inside).select("event_id", F.lit(admission.OUTSIDE).alias("reason")))


@query(f"with {ADMITTED_SQL} select event_id, (row_number() over (order by us, event_id) - 1)::bigint as output_index from ok")
def output_index(spark, sf_dir):
    return admission.output_index(_judged(spark, sf_dir).where("accepted"), ORDER, bucket=F.col("hour")).select("event_id", F.col("output_index").cast("long").alias("output_index"))


@query(f"with {ADMITTED_SQL} select position_index, (row_number() over (partition by position_index order by plane_index) - 1)::bigint as ifd, is_fill, event_id from pls")
def ifd_assign(spark, sf_dir):
    return _planes(spark, sf_dir).select("position_index", "ifd", "is_fill", "event_id")


@query(f"with {EVENTS_SQL} select event_id, (hour * 4 + c) * 2 + z as tcz, (z * 9000 + hour) * 4 + c as ztc, (c * 2 + z) * 9000 + hour as czt from ev")
def plane_index(spark, sf_dir):
    bounded = replace(LOG, time_count=9000)
    index = lambda s: admission.plane_index(s, F.col("hour"), F.col("c"), F.col("z"))
    return events(spark, sf_dir).select("event_id", index(LOG).alias("tcz"), index(replace(bounded, acquisition_order="ZTC")).alias("ztc"), index(replace(bounded, acquisition_order="CZT")).alias("czt"))


@query("""select event_id, event_id // 8 as t1, ((event_id // 2) % 4)::int as c1, (event_id % 2)::int as z1,
  (event_id // 4) % 100 as t2, (event_id % 4)::int as c2, (event_id // 400)::int as z2 from events""")
def plane_coords(spark, sf_dir):
    a = admission.plane_coordinates(LOG, F.col("event_id"))
    b = admission.plane_coordinates(replace(LOG, time_count=100, acquisition_order="ZTC"), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", *[a[k].alias(f"{k}1") for k in "tcz"], *[b[k].alias(f"{k}2") for k in "tcz"])


# validation ----------------------------------------------------------------------------------------------------------
@query("""select event_id, stride >= 8 and 60 + event_id % 10 = stride * 8 as ok from (select event_id, case when event_id % 12 = 0 or event_id % 5 = 0 then 8 else event_id % 12 end as stride from events)""")
def validate_layout(spark, sf_dir):
    stride = F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 12)
    return table(spark, sf_dir, "events").select("event_id", admission.layout_ok(LOG, 60 + F.col("event_id") % 10, stride).alias("ok"))


@query(f"""select event_id, case when not (user_id % 4 between 0 and 2 and event_id % 5 between 0 and 3 and event_id % 3 between 0 and 1 and event_id % 7 - 2 >= -1) then '{admission.OUTSIDE}'
  when value > 150 or value < 5 or event_type = 'error' then '{admission.METADATA}' end as reason from events""")
def validate_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    exposure = F.when(F.col("value") > 150, float("inf")).when(F.col("value") < 5, -1.0).otherwise(F.col("value"))
    rows = e.select(
        "event_id", (F.col("user_id") % 4).cast("int").alias("position_index"), (F.col("event_id") % 7 - 2).alias("t"), (F.col("event_id") % 5).cast("int").alias("c"), (F.col("event_id") % 3).cast("int").alias("z"), exposure.alias("exposure_ms"),
        F.struct(F.lit(1.0).alias("x_um"), F.lit(None).cast("double").alias("y_um"), F.lit(None).cast("double").alias("z_um")).alias("stage"), F.create_map(F.when(F.col("event_type") == "error", "").otherwise("k"), F.lit("v")).alias("metadata"),
    )
    return admission.validated(rows, LOG, layout=False).select("event_id", "reason")


_UUID = "'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"""with u as (select page_id, md5(url) as h from pages), v as (select page_id, case page_id % 5 when 0 then {_UUID} when 1 then upper({_UUID}) when 2 then replace({_UUID}, '-', '') when 3 then replace({_UUID}, 'a', 'g') else {_UUID} || ' ' end as u from u)
select page_id, regexp_full_match(u, 'urn:uuid:[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') as valid from v""")
def uuid_check(spark, sf_dir):
    u = F.expr(_UUID)
    k = F.col("page_id") % 5
    rows = table(spark, sf_dir, "pages").withColumn("h", F.md5("url")).withColumn("u", F.when(k == 0, u).when(k == 1, F.upper(u)).when(k == 2, F.replace(u, F.lit("-"), F.lit(""))).when(k == 3, F.replace(u, F.lit("a"), F.lit("g"))).otherwise(F.concat(u, F.lit(" "))))
    return rows.select("page_id", text.urn_uuid(F.col("u")).alias("valid"))


# layout --------------------------------------------------------------------------------------------------------------
@query("""select p_partkey, b as bytes_per_pixel, b * 8 as storage_bits, w * b as row_bytes, case when s = 0 then w * b else s end as stride, case b when 1 then 'Mono8' else 'Mono16' end as format_name, b - 1 as format_id
from (select p_partkey, p_size * 100 as w, (p_partkey % 2 + 1)::int as b, (p_partkey % 3) * 7000 as s from part)""", name="layout")
def layout_sizes(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 2 == 0, "uint8").otherwise("uint16")
    width = F.col("p_size") * 100
    return table(spark, sf_dir, "part").select("p_partkey", layout.bytes_per_pixel(kind).alias("bytes_per_pixel"), layout.storage_bits(kind).alias("storage_bits"), layout.packed_row_bytes(width, kind).alias("row_bytes"), layout.frame_stride((F.col("p_partkey") % 3) * 7000, width, kind).alias("stride"), layout.pixel_format_name(kind).alias("format_name"), layout.pixel_format_id(kind).alias("format_id"))


@query(f"select vec_id, array_to_string(list_transform(list_filter(range(0, 64), lambda i: i % 8 < 6), lambda i: v[i + 1]::varchar), ',') as samples from (select vec_id, {DENSE_SQL} as v from embeddings)")
def destride(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(layout.destrided(dense(), F.lit(8), F.lit(6)).cast("array<string>"), ",").alias("samples"))


@query("""with p as (select p_partkey, p_size * 700 as row_bytes, (p_partkey % 50 + 1) * 20 as height from part),
r as (select *, least(greatest(65536 // row_bytes, 1), height) as per from p)
select p_partkey, per as rows_per_strip, first_row, least(per, height - first_row) as rows from (select *, unnest(range(0, height, per)) as first_row from r)""")
def tiff_strips(spark, sf_dir):
    row, height = F.col("p_size").cast("long") * 700, (F.col("p_partkey") % 50 + 1) * 20
    planes = table(spark, sf_dir, "part").select("p_partkey", row.alias("row_bytes"), height.alias("height"), layout.rows_per_strip(row, height).alias("rows_per_strip"))
    return layout.strip_table(planes, "row_bytes", "height").select("p_partkey", "rows_per_strip", "first_row", "rows")


@query("""select p_partkey, color as xml_color, hex as hex_color, ((1::bigint << (p_size % 16 + 1)) - 1) as window_end from
(select p_partkey, p_size, case when rgba >= 2147483648 then rgba - 4294967296 else rgba end as color, case when rgb is null then 'FFFFFF' else lpad(printf('%X', (rgb & 16777215)::bigint), 6, '0') end as hex from
(select p_partkey, p_size, rgb, ((rgb & 16777215) << 8) | 255 as rgba from (select p_partkey, p_size, case when p_partkey % 7 <> 0 then p_partkey * 40503 end as rgb from part)))""")
def colors(spark, sf_dir):
    rgb = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") * 40503)
    return table(spark, sf_dir, "part").select("p_partkey", layout.xml_color(rgb).alias("xml_color"), layout.hex_color(rgb).alias("hex_color"), layout.window_end(F.col("p_size") % 16 + 1).alias("window_end"))


# names ---------------------------------------------------------------------------------------------------------------
@query("""select s_suppkey, case when s_suppkey % 4 = 0 then '' when s_suppkey % 4 = 1 then s_suppkey::varchar when s_suppkey % 4 = 2 then s_name else s_name || '_' || s_nationkey || '_' || (s_suppkey % 9) end as series_name from supplier""")
def series_name(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    row, column = F.when(k == 3, F.col("s_nationkey")), F.when(k == 3, F.col("s_suppkey") % 9)
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.series_name(F.when(k == 0, 1).otherwise(2), k > 1, F.col("s_suppkey"), F.col("s_name"), row, column).alias("series_name"))


@query("""select c_custkey, root, root || '/' || regexp_extract(root, '([^/]*)$', 1) || '_p' || case when c_custkey < 1000 then lpad(c_custkey::varchar, 3, '0') else c_custkey::varchar end || '.ome.tiff' as path
from (select c_custkey, regexp_replace('/data/' || c_name || case c_custkey % 4 when 0 then '.ome.tiff' when 1 then '.OME.TIF' when 2 then '.tiff' else '' end, '(?i)\\.ome\\.tiff?$', '') as root from customer)""")
def tiff_paths(spark, sf_dir):
    k = F.col("c_custkey") % 4
    path = F.concat(F.lit("/data/"), F.col("c_name"), F.when(k == 0, ".ome.tiff").when(k == 1, ".OME.TIF").when(k == 2, ".tiff").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", names.tiff_root(path).alias("root"), names.position_tiff_path(path, F.col("c_custkey")).alias("path"))


@query("""select s_suppkey, case when s_suppkey % 3 = 0 then 'Position ' || (s_suppkey + 1) else s_name end as position, case when s_suppkey % 5 = 0 then 'Channel ' || (s_suppkey + 1) else s_name end as channel,
  case when s_suppkey % 2 = 0 then 'Image' else 'Image ' || case when s_suppkey % 3 = 0 then 'Position ' || (s_suppkey + 1) else s_name end end as image from supplier""", name="names")
def default_names(spark, sf_dir):
    k = F.col("s_suppkey")
    position = names.position_name(F.when(k % 3 == 0, "").otherwise(F.col("s_name")), k)
    channel = names.channel_name(F.when(k % 5 != 0, F.col("s_name")), k)
    return table(spark, sf_dir, "supplier").select("s_suppkey", position.alias("position"), channel.alias("channel"), names.image_name(F.lit("Image"), F.when(k % 2 == 0, 1).otherwise(2), position).alias("image"))


# text ----------------------------------------------------------------------------------------------------------------
@query("select conv_id, turn, md5(replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as escaped from (select conv_id, turn, '<\"' || turn || '\"> & ''' || text as x from conversations)")
def escape(spark, sf_dir):
    x = F.concat(F.lit('<"'), F.col("turn").cast("string"), F.lit('"> & \''), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.xml_escaped(x)).alias("escaped"))


@query("""select conv_id, turn, md5(to_json(x)::varchar) as escaped from (select conv_id, turn, '"' || turn || '\\' || chr(9) || chr(10) || chr(13) || text as x from conversations)""")
def escape_json(spark, sf_dir):
    x = F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit("\\\t\n\r"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.json_escaped(x)).alias("escaped"))


@query("""select page_id, case when regexp_matches(x, '[,"\\n\\r]') then '"' || replace(x, '"', '""') || '"' else x end as field from (select page_id, case page_id % 4 when 0 then url when 1 then url || ', "a"' when 2 then '"' else url || chr(10) end as x from pages)""")
def csv_field(spark, sf_dir):
    k = F.col("page_id") % 4
    x = F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit(', "a"'))).when(k == 2, '"').otherwise(F.concat("url", F.lit("\n")))
    return table(spark, sf_dir, "pages").select("page_id", text.csv_escaped(x).alias("field"))


@query("""select page_id, len(f)::int as n_fields, f[1] as first, f[2] as second, f[3] as third, x is null as open_ended from
(select page_id, case page_id % 4 when 3 then null else 1 end as x, case page_id % 4 when 0 then [page_id::varchar, url, ''] when 1 then [url || ', "a"', page_id::varchar, 'x"y'] when 2 then ['', '"', url || chr(10)] end as f from pages)""")
def csv_split(spark, sf_dir):
    """Records with quoted commas, quotes and line ends, fields with quotes inside, and a quoted field that does not end."""
    k, quoted = F.col("page_id") % 4, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    number, url = F.col("page_id").cast("string"), F.col("url")
    line = F.when(k == 0, F.concat_ws(",", number, url, F.lit(""))).when(k == 1, F.concat_ws(",", quoted(F.concat(url, F.lit(', "a"'))), number, F.lit('x"y')))
    line = line.when(k == 2, F.concat_ws(",", F.lit(""), quoted(F.lit('"')), quoted(F.concat(url, F.lit("\n"))))).otherwise(F.concat(number, F.lit(',"'), url))
    fields = table(spark, sf_dir, "pages").select("page_id", text.csv_split(line).alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    return fields.select("page_id", F.when(F.col("f").isNotNull(), F.size("f")).alias("n_fields"), at(0).alias("first"), at(1).alias("second"), at(2).alias("third"), F.col("f").isNull().alias("open_ended"))


@query("select p_partkey, case p_partkey % 6 when 0 then p_size::bigint when 1 then -p_partkey when 2 then p_partkey end as value from part")
def strict_integer(spark, sf_dir):
    k, size, key = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    x = F.when(k == 0, size).when(k == 1, F.concat(F.lit("-"), key)).when(k == 2, F.concat(F.lit("+00"), key)).when(k == 3, F.concat(F.lit(" "), key)).when(k == 4, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit("9"), F.repeat(size, 20)))
    return table(spark, sf_dir, "part").select("p_partkey", text.integer(x).alias("value"))


@query("select p_partkey, printf('%.17g', p_retailprice * 1.1) as price, printf('%.17g', p_size / 7.0::double) as part from part")
def number_text(spark, sf_dir):
    """Doubles in 17 significant digits."""
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", text.number_text(F.col("p_retailprice") * F.lit(1.1)).alias("price"), text.number_text(size / 7.0).alias("part"))


@query(f"with {EVENTS_SQL} select event_id, case when event_id % 10 = 0 then '' else strftime(make_timestamp((us // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' end as iso from ev")
def iso_ts(spark, sf_dir):
    ns = F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("timestamp_ns") + F.col("event_id") % 1000)
    return events(spark, sf_dir).select("event_id", text.iso_timestamp(ns).alias("iso"))


@query("""select p_partkey, case when p_partkey % 4 <> 0 then p_size::bigint end as size, case when p_partkey % 4 <> 0 then -p_partkey end as other from part""")
def xml_int(spark, sf_dir):
    x = F.when(F.col("p_partkey") % 4 != 0, F.format_string('<Pixels Name="9x" SizeT="%d" Size="-%d" SizeT="1"/>', F.col("p_size"), F.col("p_partkey"))).otherwise('<Pixels SizeT="x"/>')
    return table(spark, sf_dir, "part").select("p_partkey", text.xml_integer(x, "SizeT").alias("size"), text.xml_integer(x, " Size").alias("other"))


@query(f"""with {EVENTS_SQL} select event_id, case when timestamp_ns >= {(1_704_067_200_000_000 + 86_400_000_000 * 30) * 1000} then (timestamp_ns - {(1_704_067_200_000_000 + 86_400_000_000 * 30) * 1000}) // 1000000 end::bigint as delta_ms,
  case when event_id % 3 = 0 then 5000 else case when value > 0 then round(value * 1000) else 5000 end end::bigint as exposure_us from ev""")
def timing(spark, sf_dir):
    start = (1_704_067_200_000_000 + 86_400_000_000 * 30) * 1000
    exposure = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))
    return events(spark, sf_dir).select("event_id", F.floor(text.delta_ms(F.col("timestamp_ns"), start)).cast("long").alias("delta_ms"), F.round(text.effective_exposure(exposure, 5.0) * 1000).cast("long").alias("exposure_us"))


# summaries -----------------------------------------------------------------------------------------------------------
@query(f"with {ADMITTED_SQL} select position_index, count(*) as planes, greatest(1, max(t) + 1) as size_t, max(t) + 1 as size_t_grown from pls group by 1")
def series_size(spark, sf_dir):
    return summary.series_sizes(_planes(spark, sf_dir), LOG)


_STAGED = "case when event_id % 11 = 0 then event_id * 2 end as sx, case when event_id % 5 = 0 then event_id end as sy"


@query(f"""with {ADMITTED_SQL}, st as (select position_index, plane_index, {_STAGED} from ok), f as (select position_index, min(plane_index) as at from st where sx is not null or sy is not null group by 1)
select st.position_index, (case when st.position_index = 0 then 1500 else sx * 1000 end)::bigint as x_nm, (case when st.position_index = 1 then 2500 else sy * 1000 end)::bigint as y_nm, (case when st.position_index = 1 then -3000 end)::bigint as z_nm
from st join f on f.position_index = st.position_index and f.at = st.plane_index""")
def stage_label(spark, sf_dir):
    k = F.col("event_id")
    stage = F.struct(F.when(k % 11 == 0, k * 2).cast("double").alias("x_um"), F.when(k % 5 == 0, k).cast("double").alias("y_um"), F.lit(None).cast("double").alias("z_um"))
    found = summary.stage_labels(_planes(spark, sf_dir).withColumn("stage", stage), LOG)
    return found.select("position_index", *[F.round(F.col(f"{a}_um") * 1000).cast("long").alias(f"{a}_nm") for a in "xyz"])


@query(f"with {ADMITTED_SQL} select position_index, bool_or(coalesce(event_type = 'error' and position_index > 0, false)) as annotated from ok group by 1")
def annotations(spark, sf_dir):
    note = F.when((F.col("event_type") == "error") & (F.col("position_index") > 0), F.create_map(F.lit("k"), F.col("props"))).otherwise(F.create_map().cast("map<string,string>"))
    return summary.has_annotations(_planes(spark, sf_dir).withColumn("metadata", note))


@query("select event_id, (event_id * 7 % 100 + 1) as payload_bytes, coalesce(sum(event_id * 7 % 100 + 1) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as payload_offset from events")
def binary_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 7 % 100 + 1).alias("payload_bytes"))
    return summary.payload_offsets(rows, ("event_id",), ("user_id",)).select("event_id", "payload_bytes", "payload_offset")


# tiles ---------------------------------------------------------------------------------------------------------------
_GRID = plane_settings("grid", "ome-zarr")
_GRID_SQL = """g as (select vec_id, sy, sx, k, sy * 2 + k // 2 as cy, sx * 2 + k % 2 as cx from embeddings, unnest([0, 1]) as a(sy), unnest([0, 1]) as b(sx), unnest([0, 1, 2, 3]) as d(k)),
h as (select *, cy < 3 and cx < 3 as inside, cy * 3 as y0, cx * 3 as x0 from g)"""


@query(f"""with {_GRID_SQL} select vec_id, sy as shard_y, sx as shard_x, k as chunk_index, cy as chunk_y, cx as chunk_x, inside as in_image, case when inside then least(3, 8 - y0) else 0 end as copy_h, case when inside then least(3, 8 - x0) else 0 end as copy_w,
  '0/c/' || vec_id || '/0/' || vec_id % 4 || '/' || sy || '/' || sx as path from h""")
def chunk_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("t"), F.lit(0).alias("c"), (F.col("vec_id") % 4).alias("z"))
    return tiling.chunk_grid(rows, _GRID).select("vec_id", "shard_y", "shard_x", "chunk_index", "chunk_y", "chunk_x", "in_image", "copy_h", "copy_w", "path")


_TILE_SQL = f"""{_GRID_SQL}, t as (select h.vec_id, cy, cx, list_transform(range(0, 9), lambda q: case when y0 + q // 3 < 8 and x0 + q % 3 < 8 then v[(y0 + q // 3) * 8 + x0 + q % 3 + 1] else 0 end) as tile
from h join (select vec_id, {SPARSE_SQL} as v from embeddings) e on e.vec_id = h.vec_id where inside)"""


def _tiles(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sparse().alias("v"), F.col("vec_id").alias("t"), F.lit(0).alias("c"), F.lit(0).alias("z"))
    grid = tiling.chunk_grid(rows, _GRID).where("in_image")
    return grid.withColumn("tile", tiling.tile_of(F.col("v"), _GRID, F.col("y0"), F.col("x0")))


@query(f"with {_TILE_SQL} select vec_id, cy as chunk_y, cx as chunk_x, array_to_string(list_transform(tile, lambda x: x::varchar), ',') as samples from t")
def tile(spark, sf_dir):
    return _tiles(spark, sf_dir).select("vec_id", "chunk_y", "chunk_x", F.array_join(F.col("tile").cast("array<string>"), ",").alias("samples"))


@query(f"with {_TILE_SQL} select vec_id, count(*) filter (where len(list_filter(tile, lambda x: x <> 0)) = 0) as empty_chunks, count(*) as chunks from t group by 1")
def zero_chunks(spark, sf_dir):
    empty = ~F.exists("tile", lambda x: x != 0)
    return _tiles(spark, sf_dir).groupBy("vec_id").agg(F.sum(empty.cast("long")).alias("empty_chunks"), F.count("*").alias("chunks"))


# whole datasets ------------------------------------------------------------------------------------------------------
def _samples(raw):
    """Bytes as comma-parted numbers."""
    pairs = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10))
    return F.array_join(pairs, ",")


_NUMBERS = "array_to_string(list_transform(v, lambda x: x::varchar), ',')"


def _written(spark, sf_dir, kind: str, samples, **more) -> Settings:
    path = new_path(spark, kind)
    if kind != "ome-zarr":
        path = f"{path}/planes.{'ome.tiff' if kind == 'ome-tiff' else kind}"
    s = plane_settings(path, kind, z_count=4 if kind.startswith("ome") else 1, frame_metadata_path=f"{path}.csv" if kind == "binary" else "", **more)
    dataset.write(plane_frames(spark, sf_dir, samples), s)
    return s


@query(f"select vec_id // 4 as t, 0 as c, (vec_id % 4)::int as z, {_NUMBERS} as samples from (select row_number() over (order by vec_id) - 1 as vec_id, {SPARSE_SQL} as v from embeddings)")
def read_zarr(spark, sf_dir):
    s = _written(spark, sf_dir, "ome-zarr", sparse())
    rows = dataset.scan(spark, s.output_path, "ome-zarr")
    n = table(spark, sf_dir, "embeddings").count()
    return rows.where(F.col("frame_number") < n).select("t", "c", "z", _samples(F.col("bytes")).alias("samples"))


_PAGES = "row_number() over (order by vec_id) - 1"


def _page_tags(spark, path: str) -> DataFrame:
    """The tags of every page of a file."""
    tags = {"width": tiff_codec.WIDTH, "height": tiff_codec.HEIGHT, "bits": tiff_codec.BITS, "compression": tiff_codec.COMPRESSION, "predictor": tiff_codec.PREDICTOR, "rows_per_strip": tiff_codec.ROWS_PER_STRIP}

    def pages(it):
        for pdf in it:
            for _ in range(len(pdf)):
                with files.opened(path) as f:
                    reader = tiff_codec.PageReader(f)
                    rows = [{"page": k, "described": tiff_codec.DESCRIPTION in x} | {n: reader.values(x, t)[0] for n, t in tags.items()} for k, x in enumerate(reader.directories())]
                yield pd.DataFrame(rows)

    return spark.range(1, numPartitions=1).mapInPandas(pages, "page long, described boolean, " + ", ".join(f"{n} long" for n in tags))


_TAGS_SQL = "8::bigint as width, 8::bigint as height, 8::bigint as bits, 8::bigint as compression, 2::bigint as predictor, 8::bigint as rows_per_strip"


@query(f"select row_number() over (order by vec_id) - 1 as page, true as described, {_TAGS_SQL} from embeddings")
def write_tiff(spark, sf_dir):
    return _page_tags(spark, _written(spark, sf_dir, "tiff", dense()).output_path)


@query(f"select row_number() over (order by vec_id) - 1 as page, row_number() over (order by vec_id) = 1 as described, {_TAGS_SQL} from embeddings")
def write_ome_tiff(spark, sf_dir):
    return _page_tags(spark, _written(spark, sf_dir, "ome-tiff", dense()).output_path)


@query("""select '0/c/' || k // 4 || '/0/' || k % 4 || '/' || sy || '/' || sx as path, true as shard from (select row_number() over (order by vec_id) - 1 as k from embeddings), unnest([0, 1]) as a(sy), unnest([0, 1]) as b(sx)
union all select unnest(['0/zarr.json', 'zarr.json', 'planeframe.frames.jsonl']), false""")
def write_zarr(spark, sf_dir):
    """Every file of a dataset."""
    root = _written(spark, sf_dir, "ome-zarr", sparse()).output_path
    rows = dataset.stored(spark, root)
    inside = F.element_at(F.split("path", root.rsplit("/", 1)[1] + "/"), 2)
    return rows.select(inside.alias("path"), inside.startswith("0/c/").alias("shard"))


@query(f"select {_PAGES} as frame_number, vec_id::varchar as frame_index, (vec_id * 1000 + 1704067200000000000)::varchar as timestamp_ns, 'cam, ' || label as camera_id, {_NUMBERS} as samples from (select vec_id, label, {DENSE_SQL} as v from embeddings)")
def read_tiff(spark, sf_dir):
    s = _written(spark, sf_dir, "tiff", dense())
    rows = dataset.scan(spark, s.output_path, "tiff")
    return rows.select("frame_number", F.col("frame_index").cast("string").alias("frame_index"), F.col("timestamp_ns").cast("string").alias("timestamp_ns"), "camera_id", _samples(F.col("bytes")).alias("samples"))


@query(f"select {_PAGES} as frame_number, 8 as significant_bits, {_NUMBERS} as samples from (select vec_id, {DENSE_SQL} as v from embeddings)")
def read_ome_tiff(spark, sf_dir):
    s = _written(spark, sf_dir, "ome-tiff", dense())
    return dataset.scan(spark, s.output_path, "ome-tiff").select("frame_number", "significant_bits", _samples(F.col("bytes")).alias("samples"))


@query(f"select {_PAGES} as frame_number, vec_id::varchar as frame_index, 'cam, ' || label as camera_id, 8::bigint as stride, {_NUMBERS} as samples from (select vec_id, label, {DENSE_SQL} as v from embeddings)")
def read_binary(spark, sf_dir):
    s = _written(spark, sf_dir, "binary", dense())
    rows = dataset.scan(spark, s.output_path, "binary", s.frame_metadata_path)
    return rows.select("frame_number", F.col("frame_index").cast("string").alias("frame_index"), "camera_id", "stride", _samples(F.col("bytes")).alias("samples"))


@query("""select line from (select 'camera_id,frame_index,timestamp_ns,width,height,bits_per_sample,stride,pixel_format,pixel_format_id,payload_bytes,source_roi_x,source_roi_y,source_roi_width,source_roi_height' as line
union all select '"cam, ' || label || '",' || vec_id || ',' || (vec_id * 1000 + 1704067200000000000) || ',8,8,8,8,Mono8,0,64,0,0,0,0' from embeddings)""")
def binary_csv(spark, sf_dir):
    s = _written(spark, sf_dir, "binary", dense())
    return spark.read.text(s.frame_metadata_path).select(F.col("value").alias("line"))


@query(f"""select 'ome-zarr' as kind, {_NUMBERS} as samples from (select {DENSE_SQL} as v from embeddings where vec_id = 6) union all select 'tiff', {_NUMBERS} from (select {DENSE_SQL} as v from embeddings where vec_id = 6)
union all select 'ome-tiff', {_NUMBERS} from (select {DENSE_SQL} as v from embeddings where vec_id = 6) union all select 'binary', {_NUMBERS} from (select {DENSE_SQL} as v from embeddings where vec_id = 6)""")
def point_lookup(spark, sf_dir):
    """Frame 6 of each format, by the key that the format has; vec_id counts from 0."""
    found = []
    for kind in ("ome-zarr", "tiff", "ome-tiff", "binary"):
        s = _written(spark, sf_dir, kind, dense())
        row = dataset.frame(spark, dataset.Location(kind, s.output_path, s.frame_metadata_path, frame_number=6, t=1, z=2))
        found.append((kind, ",".join(map(str, bytes(row["bytes"])))))
    return spark.createDataFrame(found, "kind string, samples string")


@query("""select vec_id, 'planeframe.frame-metadata.v1' as schema, 'cam, ' || label as camera_id, vec_id::varchar as frame_index, 8 as bits_per_sample, 'Mono8' as pixel_format, 0 as pixel_format_id from embeddings""")
def tiff_json_meta(spark, sf_dir):
    s = _written(spark, sf_dir, "tiff", dense())
    schema = "schema string, camera_id string, frame_index string, bits_per_sample int, pixel_format string, pixel_format_id int"
    path = s.output_path

    def pages(it):
        for pdf in it:
            for _ in range(len(pdf)):
                with files.opened(path) as f:
                    reader = tiff_codec.PageReader(f)
                    yield pd.DataFrame({"text": [reader.values(x, tiff_codec.DESCRIPTION).decode() for x in reader.directories()]})

    rows = spark.range(1, numPartitions=1).mapInPandas(pages, "text string").select(F.from_json("text", schema).alias("d")).select("d.*")
    return rows.select(F.col("frame_index").cast("long").alias("vec_id"), "*")


@query(f"""with {_TILE_SQL}, n as (select row_number() over (order by vec_id) - 1 as k, vec_id from embeddings)
select k // 4 as t, (k % 4)::int as z, (cy // 2)::int as shard_y, (cx // 2)::int as shard_x, ((cy % 2) * 2 + cx % 2)::int as chunk_index, len(list_filter(tile, lambda x: x <> 0)) > 0 as stored from t join n using (vec_id)
union all select k // 4, (k % 4)::int, sy, sx, q, false from n, unnest([0, 1]) as a(sy), unnest([0, 1]) as b(sx), unnest([0, 1, 2, 3]) as d(q) where sy * 2 + q // 2 >= 3 or sx * 2 + q % 2 >= 3""")
def shard_index(spark, sf_dir):
    s = _written(spark, sf_dir, "ome-zarr", sparse())
    rows = dataset.stored(spark, f"{s.output_path}/0/c")

    def entries(it):
        for pdf in it:
            out = []
            for path in pdf.path:
                t, _, z, y, x = map(int, path.rsplit("/", 5)[1:])
                out += [(t, z, y, x, k, e is not None) for k, e in enumerate(shards.shard_index(files.read(path), 4))]
            yield pd.DataFrame(out, columns=["t", "z", "shard_y", "shard_x", "chunk_index", "stored"])

    return rows.mapInPandas(entries, "t long, z int, shard_y int, shard_x int, chunk_index int, stored boolean")


_HEX = "array_to_string(list_transform({}, lambda x: printf('%02X', (x)::bigint)), '')"
_LE8 = "list_transform(range(0, 8), lambda i: ({} >> (8 * i)) & 255)"
#: CRC-32C of a list of bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 2197175160 * (x & 1)))), 4294967295::bigint)"


@query(f"""with {_TILE_SQL}, k as (select *, cy // 2 as sy, cx // 2 as sx, (cy % 2) * 2 + cx % 2 as slot, len(list_filter(tile, lambda x: x <> 0)) > 0 as stored from t),
every as (select e.vec_id, a.sy, b.sx, d.slot from embeddings e, unnest([0, 1]) as a(sy), unnest([0, 1]) as b(sx), unnest([0, 1, 2, 3]) as d(slot)),
s as (select every.*, coalesce(stored, false) as stored, tile, (count(*) filter (where stored) over (partition by every.vec_id, every.sy, every.sx order by every.slot rows between unbounded preceding and 1 preceding)) * 9 as place
  from every left join k on k.vec_id = every.vec_id and k.sy = every.sy and k.sx = every.sx and k.slot = every.slot),
f as (select vec_id, sy, sx, coalesce(string_agg(case when stored then {_HEX.format("tile")} end, '' order by slot), '') as body,
  flatten(list(case when stored then list_concat({_LE8.format("place::bigint")}, {_LE8.format("9::bigint")}) else list_transform(range(0, 16), lambda i: 255::bigint) end order by slot)) as idx from s group by 1, 2, 3)
select vec_id, sy::int as shard_y, sx::int as shard_x, body || {_HEX.format("idx")} as file, {_CRC.format("idx")}::bigint as check_sum from f""")
def shard_bytes(spark, sf_dir):
    """Shard files of each plane without compression, byte by byte: stored chunks, index entries, check sum of the index."""
    raw_grid = replace(_GRID, compression=False)

    def build(it):
        for pdf in it:
            out = []
            for vec_id, v in zip(pdf.vec_id, pdf.v):
                for y, x, tiles in tiling.shard_tiles(np.array(v).reshape(8, 8).astype("u1"), raw_grid):
                    raw = shards.build_shard(tiles, raw_grid)
                    out.append((vec_id, y, x, raw[:-4].hex().upper(), int.from_bytes(raw[-4:], "little")))
            yield pd.DataFrame(out, columns=["vec_id", "shard_y", "shard_x", "file", "check_sum"])

    return table(spark, sf_dir, "embeddings").select("vec_id", sparse().alias("v")).mapInPandas(build, "vec_id long, shard_y int, shard_x int, file string, check_sum long")


_WIDE = "list_transform(v, lambda x: x * 251)"  # 16-bit samples


@query(f"""with p as (select vec_id, {SPARSE_SQL} as v from embeddings), w as (select vec_id, v, {_WIDE} as u from p),
d as (select *, list_transform(range(0, 64), lambda i: (case when i % 8 = 0 then u[i + 1] else u[i + 1] - u[i] + 65536 end) % 65536) as delta from w)
select vec_id, {_HEX.format("v")} as chunk8, {_HEX.format("flatten(list_transform(u, lambda x: [x & 255, x >> 8]))")} as chunk16, {_HEX.format("flatten(list_transform(delta, lambda x: [x & 255, x >> 8]))")} as strip16,
  {_HEX.format("v")} as raw_strip8 from d""")
def codec_roundtrip(spark, sf_dir):
    """What the public codecs find in our chunks (zstd) and strips (deflate of horizontal differences; raw)."""
    import zlib

    import zstandard

    def contents(it):
        for pdf in it:
            out = []
            for vec_id, v in zip(pdf.vec_id, pdf.v):
                narrow, wide = replace(_GRID, pixel_type="uint8"), replace(_GRID, pixel_type="uint16", significant_bits=16)
                a = np.array(v).reshape(8, 8).astype("u1")
                b = (np.array(v) * 251).reshape(8, 8).astype("<u2")
                chunks = [zstandard.ZstdDecompressor().decompress(shards.encode_chunk(x, s)) for x, s in ((a, narrow), (b, wide))]
                strip = b"".join(map(zlib.decompress, tiff_codec.encode_strips(b, wide)))
                raw = b"".join(tiff_codec.encode_strips(a, replace(narrow, compression=False)))
                out.append((vec_id, *(x.hex().upper() for x in (*chunks, strip, raw))))
            yield pd.DataFrame(out, columns=["vec_id", "chunk8", "chunk16", "strip16", "raw_strip8"])

    return table(spark, sf_dir, "embeddings").select("vec_id", sparse().alias("v")).mapInPandas(contents, "vec_id long, chunk8 string, chunk16 string, strip16 string, raw_strip8 string")


@query("""select vec_id::varchar as "frameIndex", (row_number() over (order by vec_id) - 1)::varchar as "outputIndex", ((row_number() over (order by vec_id) - 1) // 4)::varchar as t, 0 as c, ((row_number() over (order by vec_id) - 1) % 4)::int as z,
  (vec_id * 1000 + 1704067200000000000)::varchar as "timestampNs", vec_id as delta_us from embeddings""")
def frames_jsonl(spark, sf_dir):
    s = _written(spark, sf_dir, "ome-zarr", sparse())
    schema = "outputIndex string, t string, c int, z int, frameIndex string, timestampNs string, deltaTMs double"
    rows = spark.read.schema(schema).json(f"{s.output_path}/{zarr_meta.frames_name(s)}")
    return rows.select("frameIndex", "outputIndex", "t", "c", "z", "timestampNs", F.round(F.col("deltaTMs") * 1000).cast("long").alias("delta_us"))


@query("""select 'shape' as key, '[' || ((count(*) + 3) // 4) || ', 1, 4, 8, 8]' as value from embeddings union all select 'chunk', '[1, 1, 1, 6, 6]' union all select 'inner', '[1, 1, 1, 3, 3]' union all select 'codec', 'zstd' union all select 'axes', 't,c,z,y,x' union all select 'type', 'uint8'""", name="zarr_meta")
def zarr_meta_documents(spark, sf_dir):
    s = _written(spark, sf_dir, "ome-zarr", sparse())
    array, group = (json.loads(files.read(f"{s.output_path}/{p}zarr.json")) for p in ("0/", ""))
    inner = array["codecs"][0]["configuration"]
    rows = [("shape", array["shape"]), ("chunk", array["chunk_grid"]["configuration"]["chunk_shape"]), ("inner", inner["chunk_shape"]), ("codec", inner["codecs"][1]["name"]), ("axes", ",".join(a["name"] for a in group["attributes"]["ome"]["multiscales"][0]["axes"])), ("type", array["data_type"])]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "key string, value string")


@query("select (row_number() over (order by vec_id) - 1)::bigint as ifd, (row_number() over (order by vec_id) - 1) // 4 as first_t, ((row_number() over (order by vec_id) - 1) % 4)::bigint as first_z, vec_id as delta_us from embeddings", name="ome_xml")
def ome_xml_planes(spark, sf_dir):
    """TiffData and Plane elements of the document in the first page."""
    s = _written(spark, sf_dir, "ome-tiff", dense())
    with files.opened(s.output_path) as f:
        reader = tiff_codec.PageReader(f)
        document = reader.values(next(reader.directories()), tiff_codec.DESCRIPTION).decode()
    rows = spark.createDataFrame([(document,)], "x string")
    data = rows.select(F.posexplode(F.regexp_extract_all("x", F.lit(r"<TiffData [^>]*>"), F.lit(0))).alias("k", "e"))
    plane = rows.select(F.posexplode(F.regexp_extract_all("x", F.lit(r"<Plane [^>]*>"), F.lit(0))).alias("k", "p"))
    both = data.join(plane, "k")
    return both.select(text.xml_integer(F.col("e"), "IFD").alias("ifd"), text.xml_integer(F.col("e"), "FirstT").alias("first_t"), text.xml_integer(F.col("e"), "FirstZ").alias("first_z"), F.round(F.regexp_extract("p", r'DeltaT="([^"]*)"', 1).cast("double") * 1000).cast("long").alias("delta_us"))


@query(f"with {ADMITTED_SQL} select position_index, plane_index, is_fill, t, c, z from pls")
def stream_admit(spark, sf_dir):
    """The log in four micro-batches by time gives the planes of the whole log."""
    folder = new_path(spark, "stream")
    e = events(spark, sf_dir)
    edges = e.agg(F.min("us"), F.max("us")).first()
    step = F.floor((F.col("us") - edges[0]) * 4 / (edges[1] - edges[0] + 1)).cast("int")
    # numbered by (us, event_id), whatever the ids are; written once, as every batch reads it
    numbered = written(admission.output_index(e, ORDER, bucket=F.col("hour")).withColumnRenamed("output_index", "seq"), "numbered")
    rows = numbered.withColumn("bytes", F.unhex(F.lit("00" * 64)))
    appender = FrameAppender(replace(LOG, output_path=f"{folder}/log.ome.tiff", format="ome-tiff", overwrite=True), f"{folder}/staging")
    for k in range(4):
        appender.append(rows.where(step == k), k)
    forget(numbered)
    planes = spark.read.parquet(f"{folder}/staging/planes/*")
    return planes.select("position_index", "plane_index", "is_fill", "t", "c", "z")


@query(f"select vec_id // 4 as t, (vec_id % 4)::int as z, {_NUMBERS} as samples from (select row_number() over (order by vec_id) - 1 as vec_id, {SPARSE_SQL} as v from embeddings)")
def stream_zarr(spark, sf_dir):
    """A streaming query that appends planes to a Zarr dataset and goes on from its checkpoint when more have come, then a scan of it. A batch is as many files as there are."""
    folder = new_path(spark, "stream")
    source = plane_frames(spark, sf_dir, sparse())
    n = source.count()
    cut = n // 2
    appender = FrameAppender(plane_settings(f"{folder}/planes.ome.zarr", "ome-zarr", z_count=4), f"{folder}/staging")
    for part in (source.where(F.col("seq") < cut), source.where(F.col("seq") >= cut)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
        append_stream(stream, appender, f"{folder}/checkpoint").awaitTermination()
    appender.close(spark)
    rows = dataset.scan(spark, f"{folder}/planes.ome.zarr", "ome-zarr").where(F.col("frame_number") < n)
    return rows.select("t", "z", _samples(F.col("bytes")).alias("samples"))


def _streamed(spark, sf_dir, kind: str) -> DataFrame:
    """Planes in two micro-batches, flushed after each, into a plain file; then a scan of it."""
    folder = new_path(spark, "stream")
    path = f"{folder}/planes.{kind}"
    s = plane_settings(path, kind, frame_metadata_path=f"{path}.csv" if kind == "binary" else "")
    source = plane_frames(spark, sf_dir, dense())
    cut = source.count() // 2
    appender = FrameAppender(s, f"{folder}/staging")
    for k, part in enumerate((source.where(F.col("seq") < cut), source.where(F.col("seq") >= cut))):
        appender.append(part, k)
        appender.flush(spark)
    rows = dataset.scan(spark, path, kind, s.frame_metadata_path)
    return rows.select("frame_number", F.col("frame_index").cast("string").alias("frame_index"), "camera_id", _samples(F.col("bytes")).alias("samples"))


_STREAMED_SQL = f"select {_PAGES} as frame_number, vec_id::varchar as frame_index, 'cam, ' || label as camera_id, {_NUMBERS} as samples from (select vec_id, label, {DENSE_SQL} as v from embeddings)"


@query(_STREAMED_SQL)
def stream_tiff(spark, sf_dir):
    return _streamed(spark, sf_dir, "tiff")


@query(_STREAMED_SQL)
def stream_binary(spark, sf_dir):
    return _streamed(spark, sf_dir, "binary")


@query(f"select 'empty' as what, 0::bigint as files, 0::bigint as frames union all select 'written again', (select count(*) + 3 from embeddings), (select ((count(*) + 3) // 4) * 4 from embeddings) union all select 'refused', 1, 0")
def overwrite(spark, sf_dir):
    """An input without frames makes no TIFF file; an output that is there is refused, or replaced whole where the settings allow it."""
    frames = plane_frames(spark, sf_dir, dense())
    folder = new_path(spark, "again")
    none = plane_settings(f"{folder}/none.tiff", "tiff")
    dataset.write(frames.limit(0), none)
    s = plane_settings(f"{folder}/planes.zarr", "ome-zarr", z_count=4)
    s = replace(s, chunk_width=8, chunk_height=8, shard_width_chunks=1, shard_height_chunks=1)
    dataset.write(frames.where("seq < 3"), s)
    refused = False
    try:
        dataset.write(frames.where("seq < 3"), replace(s, overwrite=False))
    except PlaneFrameError:
        refused = True
    dataset.write(frames, s)
    rows = [("empty", int(files.exists(none.output_path)), 0), ("written again", len(files.walk(s.output_path)), dataset.scan(spark, s.output_path, "ome-zarr", pixels=False).count()), ("refused", int(refused), 0)]
    return spark.createDataFrame(rows, "what string, files long, frames long")


@query(f"select vec_id, {_NUMBERS} as samples from (select {_PAGES} as vec_id, {SPARSE_SQL} as v from embeddings)")
def chunk_reassembly(spark, sf_dir):
    """Planes pasted from shard files by group path, without Spark's reader."""
    s = _written(spark, sf_dir, "ome-zarr", sparse())
    group = s.output_path

    def planes(it):
        array = zarr_meta.parse_array(files.read(f"{group}/0/zarr.json"))
        for pdf in it:
            yield pd.DataFrame({"vec_id": pdf.id, "samples": [",".join(map(str, zarr_plane(group, array, k // 4, 0, k % 4).ravel().tolist())) for k in pdf.id]})

    return spark.range(table(spark, sf_dir, "embeddings").count()).mapInPandas(planes, "vec_id long, samples string")
