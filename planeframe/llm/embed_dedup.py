"""Embedding near duplicates: int8 tile products with rigorous error bounds, full precision only where a pair may link.

A unit vector u is held as s * q with int8 q and s = max|u| / 127. With the exact residual r = |u - s q| and a = |s q|,
``|u.v - s_u s_v q_u.q_v| <= a_u r_v + r_u a_v + r_u r_v``, so a pair whose quantised product plus this bound stays under the threshold
cannot link; all others are computed again in double precision from the stored vectors. Integer products are summed in float32
exactly while 127^2 * dimensions < 2^24 and in float64 beyond.

Only vectors of one label and one length meet. Equal vectors of a label are one class, named by a hash of both. A label's classes are dealt to tiles by hash,
a task compares two tiles, and rows are copied once for each tile of their label: first as int8 with scale and bounds, to tell which rows of the two tiles are in a pair
that may link; only these go to the pair of tiles again with their full vectors. Then a task returns the number of links
of each class and a spanning forest of the links it saw, never the links themselves, so a group of thousands of near copies
costs its comparisons and a few rows.

Edge cases: labels may be of any type, equal ones have equal text; vectors that are null, empty, zero or hold a null or non-finite component, and null labels, link with nothing; a
null vec_id links with nothing, has no component and is kept; rows that repeat a vec_id are separate vectors of one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, done, small_batches, table, written
from .components import components

THRESHOLD = 0.98
TILE = 2048
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length -> int8 rows, scales, lengths of the quantised rows and upper bounds of the residuals."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1) + SLACK, np.linalg.norm(unit - back, axis=1) + SLACK


def _kind(dim: int) -> type:
    return np.float32 if 127 * 127 * dim < 1 << 24 else np.float64


def may_link(x: tuple, y: tuple, threshold: float = THRESHOLD, rows: int = 256):
    """Pairs (i, j) of quantised rows whose bound reaches the threshold, a block of x's rows at a time: yields (i, j) index arrays."""
    (qx, sx, ax, rx), (qy, sy, ay, ry) = x, y
    kind = _kind(qx.shape[1])
    right = np.ascontiguousarray(qy.astype(kind).T)
    for at in range(0, len(qx), rows):
        cut = slice(at, at + rows)
        bound = (qx[cut].astype(kind) @ right).astype(np.float64) * (sx[cut, None] * sy) + (ax[cut, None] * ry + rx[cut, None] * ay + rx[cut, None] * ry)
        i, j = np.nonzero(bound >= threshold - SLACK)
        yield i + at, j


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, rows: int = 256):
    """Pairs (i, j) of rows of x and y with cosine >= threshold, a block of x's rows at a time: yields (i, j) index arrays."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for i, j in may_link(quantise(x / nx[:, None]), quantise(y / ny[:, None]), threshold, rows):
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            keep[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
        yield i[keep], j[keep]


def _clean(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    out: dict[str, list] = {k: [None] * n for k in ("print", "raw", "dim", "q", "scale", "len", "rest")}
    by_dim: dict[int, list] = {}
    for k, (vec_id, vec, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
        if vec and label is not None and vec_id is not None and None not in vec:
            by_dim.setdefault(len(vec), []).append((k, vec, label))
    for dim, found in by_dim.items():
        x = np.array([v for _, v, _ in found], np.float64) + 0.0  # + 0.0: no negative zero, so equal vectors have equal bytes
        norm = np.linalg.norm(x, axis=1)
        good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
        q, *parts = quantise(x[good] / norm[good, None])
        for row, at in enumerate(np.flatnonzero(good).tolist()):
            k, _, label = found[at]
            raw = x[at].tobytes()
            name = hashlib.blake2b(label.encode("utf-8", "replace") + b"\0" + raw, digest_size=16).digest()
            for key, v in zip(out, (name, raw, dim, q[row].tobytes(), *(float(p[row]) for p in parts))):
                out[key][k] = v
    types = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["vec_id", "label", *out])


_CLEAN = "vec_id long, label string, print binary, raw binary, dim int, q binary, scale double, len double, rest double"
_MEMBER = "label string, dim int, i int, j int, side int, print binary"


def _by_tile(it):
    """(key, rows) of the groups of rows sorted by (label, dim, i, j) that have two rows at least."""
    key, held = None, []
    for batch in it:
        for label, dim, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (label, dim, i, j) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (label, dim, i, j), []
            held.append(row)
    if len(held) > 1:
        yield key, held


def _worth(threshold: float):
    """A mapInArrow function: of each pair of tiles, the members that are in a pair that may link."""
    types = [pa.string(), *[pa.int32()] * 4, pa.binary()]

    def run(it):
        for key, held in _by_tile(it):
            held.sort(key=lambda r: (r[0], r[1]))
            split = sum(r[0] == 0 for r in held)
            q = np.frombuffer(b"".join(r[2] for r in held), np.int8).reshape(len(held), -1)
            all_of = (q, *(np.array([r[k] for r in held]) for k in (3, 4, 5)))
            within = split == len(held)
            shift = 0 if within else split
            found = np.zeros(len(held), bool)
            for i, j in may_link(tuple(p[:split] for p in all_of), tuple(p[shift:] for p in all_of), threshold):
                j = j + shift
                two = i != j
                found[i[two]] = found[j[two]] = True
            at = np.flatnonzero(found).tolist()
            if at:
                columns = [*([v] * len(at) for v in key), [held[k][0] for k in at], [held[k][1] for k in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["label", "dim", "i", "j", "side", "print"])

    return run


def _group_links(held: list[tuple], threshold: float) -> pa.RecordBatch:
    """One task's tiles: (print, links) of each row with links, then the spanning forest (a, b)."""
    held = sorted(held, key=lambda r: (r[0], r[1]))
    side = np.array([r[0] for r in held])
    reps, weights = np.array([r[1] for r in held]), np.array([r[2] for r in held])
    raw = np.frombuffer(b"".join(r[4] for r in held), np.float64).reshape(len(held), -1)
    split = int((side == 0).sum())
    within = split == len(held)
    right = raw if within else raw[split:]
    shift = 0 if within else split
    links, comp, forest = np.zeros(len(held), np.int64), np.arange(len(held)), []
    for i, j in tile_links(raw[:split], right, threshold):
        j = j + shift
        if within:
            i, j = i[i != j], j[i != j]
        np.add.at(links, i, weights[j])
        if not within:
            np.add.at(links, j, weights[i])
        for k, (lo, hi) in zip(*(lambda u, at: (u, zip(at, [*at[1:], len(i)])))(*np.unique(i, return_index=True))):
            roots, first = np.unique(comp[j[lo:hi]], return_index=True)
            new = roots != comp[k]
            if new.any():
                forest += [(reps[k], reps[j[lo:hi][f]]) for f in first[new]]
                comp[np.isin(comp, roots[new])] = comp[k]
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict(
        {"print": [held[k][3] for k in some] + [None] * len(forest), "links": [int(links[k]) for k in some] + [None] * len(forest), "a": [None] * len(some) + [int(a) for a, _ in forest], "b": [None] * len(some) + [int(b) for _, b in forest]},
        schema=pa.schema([("print", pa.binary()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]),
    )


def _tiles(threshold: float):
    def run(it):
        for _, held in _by_tile(it):
            yield _group_links(held, threshold)

    return run


_TILE_KEY = ["label", "dim", "i", "j"]


def _together(rows: DataFrame) -> DataFrame:
    """The rows of each pair of tiles in one task and next to each other."""
    return rows.repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row for each input row."""
    small_batches(vectors.sparkSession)
    tables: list[DataFrame] = []

    def scratch(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    clean = scratch(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(batches(_clean), _CLEAN), "vectors")
    usable = clean.where("print is not null")
    classes = scratch(usable.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    reps = usable.join(classes, "print").where("vec_id = rep").dropDuplicates(["print"]).drop("vec_id")
    reps = scratch(reps, "reps")
    tiles = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = reps.select("label", "dim", "print", "q", "scale", "len", "rest").join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    spread = F.expr("transform(sequence(0, tiles - 1), o -> struct(least(o, tile) as i, greatest(o, tile) as j, if(o < tile, 1, 0) as side))")
    groups = placed.withColumn("p", F.explode(spread)).select("label", "dim", "p.i", "p.j", "p.side", "print", "q", "scale", "len", "rest")
    worth = scratch(_together(groups).mapInArrow(_worth(threshold), _MEMBER), "worth")
    full = worth.join(reps.select("print", "rep", "weight", "raw"), "print").select(*_TILE_KEY, "side", "rep", "weight", "print", "raw")
    seen = scratch(_together(full).mapInArrow(_tiles(threshold), "print binary, links long, a long, b long"), "tiles")
    counts = seen.where("print is not null").groupBy("print").agg(F.sum("links").alias("links"))
    same = usable.join(classes, "print").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comps = components(seen.where("a is not null").select("a", "b").unionAll(same))
    tables.append(comps)
    out = clean.select("vec_id", "print").join(classes, "print", "left").join(counts, "print", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    n = F.when(F.col("weight").isNull(), 0).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0)))
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", n.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return done(out, "links", tables)


def op4_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and list_sum(list_transform(e, lambda x: x * x)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, reach) as (select vec_id, vec_id from v union select r.node, l.b from r join l on l.a = r.reach),
c as (select node, min(reach) as component_id from r group by 1),
n as (select a, count(*) as n_links from l group by 1)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v join c on c.node = v.vec_id left join n on n.a = v.vec_id
"""
