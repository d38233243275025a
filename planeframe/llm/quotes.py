r"""Quotation linking: nested quote levels, hashed passages joined to original messages, conversations without quotes.

A quoted line begins with one or more ``>``, blanks allowed between; their number is its level. Consecutive lines of one level
are a passage. The message's own text is what has no ``>``, without attribution lines ("... wrote:") right before a quote.
Passages and own texts are normalised (lower case, white space collapsed) and hashed to 128 bits. An original
offers its whole own text, each of its paragraphs and each of its lines.

A passage links to the first message of the same conversation before the quoting one that offers it, else to the first other
message of another conversation (by conversation and turn, null conversations first). A passage of two or more lines or paragraphs
that none offers whole links by the same rule to messages whose own text has it as consecutive lines or consecutive paragraphs (blank lines do not count). A message replies to what the first linked passage of its lowest level
names, else to the message before it. ``position`` numbers a conversation by turn (ties by role and a hash of the text), gapless from 0; originals stand before
their quotations, so this is a reply order.

The joins meet one row for each (passage hash, conversation), the least turn, and one for each passage hash, its two least conversations, of which
one is not the quoting one; so a text that a third of all messages share adds no pairs. Trimmed quotes meet originals by their first two lines or
paragraphs and their number, each such pair once however many passages have it, and only the runs so found are hashed and offered. Positions are counted over ranges of turns, so a conversation with a third of all rows is no single task's.

Edge cases: null and empty texts have no quotes and an empty own text, which offers nothing; null conversations are one
conversation, which offers and links like any other, null turns come first and offer nothing; rows that repeat a message are numbered one by one and linked alike.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, done, small_batches, table, written

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]*)+)")
_ATTRIBUTION = re.compile(r"^(?:on\b.*|.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$", re.I)
TURNS = 1024
SALTS = 64


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def passage_hash(text: str) -> bytes | None:
    text = normalised(text)
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest() if text else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]) of a message."""
    own, passages = [], []
    lines = (text or "").replace("\r\n", "\n").split("\n")
    for k, line in enumerate(lines):
        m = _QUOTE.match(line)
        if m:
            level, rest = m[1].count(">"), line[m.end() :]
            if passages and passages[-1][2] == k - 1 and passages[-1][0] == level:
                passages[-1][1].append(rest)
                passages[-1][2] = k
            else:
                passages.append([level, [rest], k])
        elif not (_ATTRIBUTION.match(line.strip()) and k + 1 < len(lines) and _QUOTE.match(lines[k + 1])):
            own.append(line)
    return "\n".join(own).strip("\n"), [(level, "\n".join(x)) for level, x, _ in passages if normalised("\n".join(x))]


def sequences(text: str) -> dict[str, list[str]]:
    """Normalised lines and paragraphs, without blank ones."""
    parts = {"line": text.split("\n"), "paragraph": re.split(r"\n\s*\n", text)}
    return {kind: [n for x in xs if (n := normalised(x))] for kind, xs in parts.items()}


def offers(own: str, units: dict[str, list[str]]) -> set[bytes]:
    """Hashes of the whole own text, its paragraphs and its lines."""
    return {h for x in {own, *units["line"], *units["paragraph"]} if (h := passage_hash(x))}


def anchors(units: dict[str, list[str]], every: bool) -> list[dict]:
    """The pairs of neighbouring lines and paragraphs, or the first pair of each: hash, kind, place, and number of units from there on."""
    found = []
    for kind, xs in units.items():
        for at in range(len(xs) - 1 if every else min(1, len(xs) - 1)):
            pair = f"{kind}\n{xs[at]}\n{xs[at + 1]}".encode("utf-8", "replace")
            found.append({"anchor": hashlib.blake2b(pair, digest_size=16).digest(), "kind": kind, "start": at, "n": len(xs) - at})
    return found


_ANCHOR = pa.struct([("anchor", pa.binary()), ("kind", pa.string()), ("start", pa.int32()), ("n", pa.int32())])
_QUOTED = pa.struct([("at", pa.int32()), ("level", pa.int32()), ("hash", pa.binary()), ("runs", pa.list_(_ANCHOR))])
_ANCHORS = "array<struct<anchor:binary,kind:string,start:int,n:int>>"


def _parsed(batch: pa.RecordBatch) -> pa.RecordBatch:
    own, quotes, units, pairs = [], [], [], []
    for text in batch.column(3).to_pylist():
        o, passages = parse(text)
        own.append(o)
        quotes.append([{"at": k, "level": level, "hash": passage_hash(x), "runs": anchors(sequences(x), False)} for k, (level, x) in enumerate(passages)])
        seen = sequences(o)
        units.append(sorted(offers(o, seen)))
        pairs.append(anchors(seen, True))
    arrays = [pa.array(own, pa.string()), pa.array(quotes, pa.list_(_QUOTED)), pa.array(units, pa.list_(pa.binary())), pa.array(pairs, pa.list_(_ANCHOR))]
    return pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays, *batch.columns[4:]], ["conv_id", "turn", "role", "own", "quotes", "units", "pairs", "mid", "digest"])


def _run_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(conv_id, turn, own, wanted runs) -> (conv_id, turn, hashes of those runs)."""
    out = []
    for own, wanted in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        units = sequences(own)
        out.append(sorted({passage_hash(" ".join(units[w["kind"]][w["start"] : w["start"] + w["n"]])) for w in wanted}))
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.binary()))], ["conv_id", "turn", "units"])


def _runs(parsed: DataFrame, passages: DataFrame) -> DataFrame:
    """Offers (hash, conv_id, turn) of the runs of lines and paragraphs that begin and are as long as one of the passages (runs)."""
    needed = passages.select(F.explode("runs").alias("r")).select("r.anchor", F.col("r.n").alias("n")).distinct()
    pairs = parsed.where("size(pairs) > 0 and turn is not null").select("mid", F.explode("pairs").alias("p")).select("mid", "p.anchor", "p.kind", "p.start", F.col("p.n").alias("room"))
    wanted = pairs.join(needed, "anchor").where("n <= room").groupBy("mid").agg(F.collect_set(F.struct("kind", "start", "n")).alias("wanted"))
    own = parsed.select("conv_id", "turn", "own", "mid").join(wanted, "mid").select("conv_id", "turn", "own", "wanted")
    hashed = own.mapInArrow(batches(_run_hashes), "conv_id long, turn long, units array<binary>")
    return hashed.select(F.explode("units").alias("hash"), "conv_id", "turn")


def _originals(quoted: DataFrame, units: DataFrame) -> DataFrame:
    """Adds to quoted passages (hash, conv_id, turn, ...) the original (conv_id, turn) among the offers (hash, conv_id, turn), or null."""
    near = units.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    salted = near.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    least = salted.withColumn("k", F.row_number().over(Window.partitionBy("hash", "salt").orderBy(F.col("conv_id").asc_nulls_first()))).where("k <= 2")
    far = least.groupBy("hash").agg(F.slice(F.sort_array(F.collect_list(F.struct("conv_id", F.col("near_turn").alias("turn")))), 1, 2).alias("far"))
    near = near.select(F.col("hash").alias("near_hash"), F.col("conv_id").alias("near_conv"), "near_turn")
    links = quoted.join(near, (F.col("hash") == F.col("near_hash")) & F.col("conv_id").eqNullSafe(F.col("near_conv")), "left").join(far, "hash", "left")
    inside = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    outside = F.get(F.filter("far", lambda x: ~x["conv_id"].eqNullSafe(F.col("conv_id"))), F.lit(0))
    return links.withColumn("original", F.coalesce(inside, outside)).drop("near_hash", "near_conv", "near_turn", "far")


def linked(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) -> one row for each, with position, quotes, what it replies to, and its own text."""
    small_batches(messages.sparkSession)
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # nulls add nothing to a hash: the last two tell a null conversation from a null turn
    m = m.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text", F.when(F.col("conv_id").isNull(), 1), F.when(F.col("turn").isNull(), 2)))
    m = m.withColumn("digest", F.md5(F.coalesce(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit(""))))
    parsed = written(m.mapInArrow(batches(_parsed), f"conv_id long, turn long, role string, own string, quotes array<struct<at:int,level:int,hash:binary,runs:{_ANCHORS}>>, units array<binary>, pairs {_ANCHORS}, mid long, digest string"), "messages")
    quoted = parsed.where("size(quotes) > 0").select("mid", "conv_id", "turn", F.explode("quotes").alias("q")).select("mid", "conv_id", "turn", "q.at", "q.level", "q.hash", "q.runs").distinct()
    units = parsed.select(F.explode("units").alias("hash"), "conv_id", "turn").where("turn is not null")
    links = first_links = written(_originals(quoted, units), "links")
    trimmed = links.where("original is null and size(runs) > 0").drop("original")
    links = links.where("original is not null or size(runs) = 0").unionByName(_originals(trimmed, _runs(parsed, trimmed)))
    first = F.min(F.when(F.col("original").isNotNull(), F.struct("level", "at", "original")))
    by_message = links.groupBy("mid").agg(F.count("original").alias("n_linked"), first.getField("original").alias("original"))
    placed = _positions(parsed.select("conv_id", "turn", "role", "own", "mid", "digest", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce(F.array_max("quotes.level"), F.lit(0)).alias("max_level")))
    out = placed.join(by_message, "mid", "left")
    kind = F.when(F.col("original").isNotNull(), "quote").when(F.col("position") > 0, "previous").otherwise("first")
    result = out.select(
        "conv_id", "turn", "role", "position", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), kind.alias("reply_kind"),
        F.when(kind == "quote", F.col("original.conv_id")).when(kind == "previous", F.col("conv_id")).alias("reply_conv"),
        F.when(kind == "quote", F.col("original.turn")).when(kind == "previous", F.col("before_turn")).alias("reply_turn"), F.col("own").alias("text"),
    )
    return done(result, "conversations", [parsed, first_links])


def _positions(df: DataFrame) -> DataFrame:
    """Adds position (gapless from 0 by turn within the conversation) and before_turn, counted over ranges of turns."""
    df = df.withColumn("range", F.expr(f"coalesce(turn div {TURNS}, -9223372036854775808)")).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    sums = df.groupBy("conv", "range").agg(F.count("*").alias("n"), F.max("turn").alias("top"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.max("top").over(earlier).alias("top_before"))
    order = Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "digest")
    df = df.withColumn("position", F.row_number().over(order) - 1).withColumn("before", F.lag("turn").over(order)).join(sums, ["conv", "range"])
    df = df.withColumn("before_turn", F.when(F.col("position") == 0, F.col("top_before")).otherwise(F.col("before"))).withColumn("position", F.col("position") + F.col("n_before"))
    return df.drop("conv", "range", "before", "n_before", "top_before")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


_NORMAL = r"trim(regexp_replace(lower({}), '[ \t\n\r\f\v]+', ' ', 'g'))"
OP1_SQL = rf"""
with m as (select row_number() over () as r, conv_id, turn, role, coalesce(replace(text, chr(13) || chr(10), chr(10)), '') as x from conversations),
l as (select r, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as k from m),
q as (select *, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') as head from l),
z as (select *, len(head) - len(replace(head, '>', '')) as level, substr(line, len(head) + 1) as rest from q),
n as (select *, lead(level, 1, 0) over (partition by r order by k) as next_level, k - row_number() over (partition by r, level order by k) as run from z),
own as (select r, trim(string_agg(line, chr(10) order by k), chr(10)) as own from n
  where level = 0 and not (next_level > 0 and regexp_full_match(trim(line), '(?i)(?:on\b.*|.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*')) group by r),
p as (select r, level, min(k) as nr, {_NORMAL.format("string_agg(rest, chr(10) order by k)")} as h from n where level > 0 group by r, level, run),
quoted as (select * from p where h <> ''),
part as (select r, own as u from own union select r, unnest(regexp_split_to_array(own, '\n\s*\n')) from own union select r, unnest(string_split(own, chr(10))) from own),
unit as (select distinct r, {_NORMAL.format("u")} as h from part),
offer as (select h, conv_id, turn from unit join m using (r) where h <> '' and turn is not null),
near as (select h, conv_id, min(turn) as turn from offer group by 1, 2),
far as (select h, list(struct_pack(conv_id := conv_id, turn := turn) order by conv_id nulls first) as far from near group by 1),
link as (select quoted.r, level, nr, case when near.turn < m.turn then struct_pack(conv_id := m.conv_id, turn := near.turn) else list_filter(far, lambda f: f.conv_id is distinct from m.conv_id)[1] end as original
  from quoted join m using (r) left join near on near.h = quoted.h and near.conv_id is not distinct from m.conv_id left join far on far.h = quoted.h),
s as (select r, count(*) as n_quotes, max(level) as max_level, count(original) as n_linked, arg_min(original, (level, nr)) filter (where original is not null) as original from link group by r),
pos as (select *, row_number() over w - 1 as position, lag(turn) over w as before from m window w as (partition by conv_id order by turn nulls first, role nulls first, md5(x))),
k as (select pos.*, coalesce(n_quotes, 0) as n_quotes, coalesce(max_level, 0)::int as max_level, coalesce(n_linked, 0) as n_linked, original,
  case when original is not null then 'quote' when position > 0 then 'previous' else 'first' end as reply_kind from pos left join s using (r))
select conv_id, turn, role, position, n_quotes, max_level, n_linked, reply_kind, case reply_kind when 'quote' then original.conv_id when 'previous' then conv_id end as reply_conv,
  case reply_kind when 'quote' then original.turn when 'previous' then before end as reply_turn, coalesce(own, '') as text from k left join own using (r)
"""
