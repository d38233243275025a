"""Near duplicates by an LSH forest over MinHash signatures.

A document's set is its distinct five-word shingles. Two documents link when
``100 * |A & B| >= 75 * |A | B|``; every link is confirmed on the full sets.

The forest holds the signatures in several sorted orders (trees):

1. *Deep neighbours.* In a few orders, sorted by a long signature prefix and range-partitioned (so a
   family of near copies of any size is cut into even ranges), each document and its neighbour are a
   candidate when their longest common prefix reaches the least depth. Confirmed neighbours join whole
   families with a number of checks that is linear in the documents.
2. *Open regions.* A region is what shares the least-depth prefix in one of all the trees. A region whose
   members are one component is closed: nothing in it can change the result. Of open ones, regions of up to SMALL documents name
   their pairs. The members of a larger one are sorted by the hashes below the region's prefix and each meets the NEAREST rows on either side, which are those of
   longest common prefix: how deep that is follows from how crowded the region is there. The likeliest partner of another component becomes a candidate, one for each row
   and tree. Regions that are still open are cut into tiles at the least depth; the largest component of a region that needs more than one tile meets the other rows only, not itself.
   Size ratio and signature agreement (five standard deviations below the threshold) decide which pairs are worth a
   full comparison, pairs of one component are skipped, and at the least depth a pair is looked at in its first common region only. Pairs of
   tiles travel twice: first signatures alone, which tell the documents that have a pair worth comparing, then these with their texts; a task returns a
   forest of confirmed links, so no task holds a whole region and no region emits its pairs.

With ``trees = 32`` of depth 3 a pair at exactly 0.75 is missed with probability 2e-8, a pair at 0.8 with 2e-10.
There is no cap on regions, partners or candidates. Sets are compared as 64-bit hashes of their shingles: in two documents of a million shingles
some two different ones share a hash with probability 1e-7, which could move the similarity by 1e-6.

Edge cases: null or blank texts have no shingles and link with nothing; a text of one to four words is one shingle; rows
with equal sets are one class; a null doc_id is its own row with a null component and is kept; rows that
repeat a doc_id are one node of the link graph, whatever their texts. ``without_near_duplicates`` looks at rows: one with another text under the same doc_id is another document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, done, forget, small_batches, table, utf8, written
from .components import components

WORDS = 5
TREES, DEPTH = 32, 3
ORDERS, ORDER_DEPTH = 4, 16
#: A tile has about so many documents, and about so many shingles (16 MB of hashes), whichever makes it smaller.
TILE, TILE_SHINGLES = 1024, 2_000_000
SMALL = 64
#: Rows on either side that a row of a crowded region meets in a sorted order.
NEAREST = 8
HASHES = TREES * DEPTH

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_MULT = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _powers[:] = []
        for base in (_BASE, _INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z lower-cased, words parted by ASCII white space.

    A rolling polynomial hash over the normalised bytes gives every shingle in a few vector operations.
    """
    parts = utf8(text).lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    raw = np.frombuffer(joined, np.uint8)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    if len(parts) < words:
        starts, ends = np.array([0]), np.array([len(raw)])
    else:
        gaps = np.flatnonzero(raw == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(parts) - words + 1]
        ends = np.concatenate((gaps, [len(raw)]))[words - 1 :]
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.unique(h)


def signature(hashes: np.ndarray) -> bytes:
    """The upper halves of the least products with each multiplier, big endian, so that byte order is number order."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * _MULT).min(0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, prints, sigs = [], [], []
    for text in batch.column(2).to_pylist():
        h = shingle_hashes(text)
        n.append(len(h))
        prints.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
        sigs.append(signature(h) if len(h) else None)
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "body", "n_shingles", "print", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, body, n_shingles, print, sig) of every row; body is a hash of the text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(batches(_sign), "doc_id long, body long, n_shingles long, print binary, sig binary")


def _near(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


class _Nodes:
    """Names of rows in the link graph: doc_id, or for a doc_id that stands for several texts a hash of it and of the text."""

    def __init__(self, signed: DataFrame, tables: list, broadcast_ids: int = 500_000):
        seen = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("body").alias("low"), F.max("body").alias("high"))
        repeated = _scratch(seen.where("k > 1"), "repeated", tables)
        self.several = repeated.where("low <> high").select(F.col("doc_id").alias("several"))
        n = self.several.count()
        self.some, self.few, self.repeats = n > 0, n <= broadcast_ids, not repeated.isEmpty()

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` (doc_id, body, ...) with node."""
        if not self.some:
            return df.withColumn("node", F.col("doc_id"))
        joined = df.join(_near(self.several, self.few), F.col("doc_id") == F.col("several"), "left")
        return joined.withColumn("node", F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "body"))).drop("several")


def _neighbours(it):
    """Adjacent rows of a sorted order whose common prefix has DEPTH hashes at least."""
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        if last is not None:
            ids, keys = np.concatenate(([last[0]], ids)), [last[1], *keys]
        last = (ids[-1], keys[-1])
        head = np.frombuffer(b"".join(k[: 1 + 4 * DEPTH] for k in keys), np.uint8).reshape(len(keys), -1)
        at = np.flatnonzero((head[1:] == head[:-1]).all(1))
        a, b = ids[at], ids[at + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _deep_neighbours(reps: DataFrame) -> DataFrame:
    """Candidates (a, b): neighbours in each of ORDERS sorted signature orders."""
    step = HASHES // ORDERS
    keys = F.array(*[F.concat(F.unhex(F.lit(f"{t:02x}")), F.expr(f"substring(sig, {4 * step * t + 1}, {4 * min(ORDER_DEPTH, step)})")) for t in range(ORDERS)])
    rows = reps.select("rep", F.explode(keys).alias("key"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "key", "rep").sortWithinPartitions("key", "rep")
    return ordered.mapInArrow(_neighbours, "a long, b long").where("a <> b").distinct()


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    keep, memo, last = np.zeros(len(a), bool), {}, None
    for i, (x, y) in enumerate(zip(left, right)):
        if last is None or last[0] != a[i]:
            last = (a[i], shingle_hashes(x))
        if b[i] not in memo:
            if len(memo) > 64:
                memo.clear()
            memo[b[i]] = shingle_hashes(y)
        hx, hy = last[1], memo[b[i]]
        if 100 * min(len(hx), len(hy)) < 75 * max(len(hx), len(hy)):
            continue
        both = len(np.intersect1d(hx, hy, assume_unique=True))
        keep[i] = 100 * both >= 75 * (len(hx) + len(hy) - both)
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _scratch(df: DataFrame, name: str, tables: list) -> DataFrame:
    """A written table that ``tables`` remembers for deletion."""
    tables.append(written(df, name))
    return tables[-1]


def texts_of(ids: DataFrame, docs: DataFrame, tables: list, broadcast_ids: int = 500_000) -> DataFrame:
    """(node, text) of the documents (node, text) in ``ids`` (node, repeats allowed).

    The ids are broadcast while there are at most ``broadcast_ids`` (8 MB), so no other text travels; beyond that they are joined by a shuffle.
    """
    ids = _scratch(ids.distinct(), "ids", tables)
    return docs.select("node", "text").join(_near(ids, ids.count() <= broadcast_ids), "node", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, tables: list) -> DataFrame:
    """The candidate pairs (a, b) that link on their full sets."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, tables)
    pairs = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    pairs = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(batches(_verify), "a long, b long")


def _agreement(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Pairs whose sizes and signatures allow a link: agreement within five standard deviations of the threshold."""
    floor = 0.75 - 5 * (0.75 * 0.25 / HASHES) ** 0.5
    return (100 * np.minimum(na, nb) >= 75 * np.maximum(na, nb)) & ((a == b).mean(-1) >= floor)


def _first_tree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first tree in which pairs of signatures share their region: a pair is looked at there only."""
    return (a == b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], TREES, DEPTH).all(-1).argmax(-1)


def _shared(h: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted hashes ``h`` each of the other sets has."""
    every = np.concatenate(others)
    hit = h[np.minimum(np.searchsorted(h, every), len(h) - 1)] == every
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]))


class _Group:
    """The rows of one task's tiles: [(side, rep, comp, n, sig, text or None)] in a region of ``tree``."""

    def __init__(self, tree: int, rows: list[list]):
        rows.sort(key=lambda r: (r[0], r[1]))
        self.tree, self.rows = tree, rows
        self.side, self.rep, self.comp, self.n = (np.array([r[k] for r in rows]) for k in range(4))
        self.sig = np.frombuffer(b"".join(r[4] for r in rows), ">u4").astype(np.uint32).reshape(len(rows), HASHES)
        self.split = int((self.side == 0).sum())
        self.within = self.split == len(rows)

    def candidates(self):
        """(i, js): rows of different components whose sizes and signatures allow a link."""
        for i in range(self.split):
            js = np.arange(i + 1 if self.within else self.split, len(self.rows))
            js = js[self.comp[js] != self.comp[i]]
            js = js[_agreement(self.sig[js], self.sig[i], self.n[js], self.n[i])]
            js = js[_first_tree(self.sig[js], self.sig[i]) == self.tree]
            if len(js):
                yield i, js

    def pairs(self) -> list[tuple[int, int]]:
        return [tuple(sorted((int(self.rep[i]), int(self.rep[j])))) for i, js in self.candidates() for j in js]

    def worth(self) -> list[int]:
        """The rows that are in a pair worth comparing."""
        found = np.zeros(len(self.rows), bool)
        for i, js in self.candidates():
            found[i] = found[js] = True
        return np.flatnonzero(found).tolist()

    def links(self, step: int = 64) -> list[tuple[int, int]]:
        """A forest of confirmed links between the components, likeliest partners first."""
        sets: dict[int, np.ndarray] = {}
        found = []

        def of(k):
            if k not in sets:
                sets[k] = shingle_hashes(self.rows[k][5])
            return sets[k]

        for i, js in self.candidates():
            js = js[np.argsort(-(self.sig[js] == self.sig[i]).sum(1), kind="stable")]
            while len(js):
                now, js = js[:step], js[step:]
                both = _shared(of(i), [of(k) for k in now])
                for k in now[100 * both >= 75 * (self.n[i] + self.n[now] - both)]:
                    if self.comp[k] != self.comp[i]:
                        found.append((int(self.rep[i]), int(self.rep[k])))
                        self.comp[self.comp == self.comp[k]] = self.comp[i]
                js = js[self.comp[js] != self.comp[i]]
        return found


_KEY = ["region", "i", "j", "tree"]
_MEMBER = "region long, i int, j int, tree int, side int, rep long, comp long, n long, sig binary"


def _grouped(it):
    """The groups (key, rows) of rows sorted by (region, i, j); a group has two tiles at most."""
    key, rows = None, []
    for batch in it:
        for *new, side, rep, comp, n, sig, text in zip(*(c.to_pylist() for c in batch.columns)):
            if new != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = new, []
            rows.append([side, rep, comp, n, sig, text])
    if len(rows) > 1:
        yield key, rows


def _edges(result):
    """A mapInArrow function: the pairs that ``result`` gives for each group."""

    def run(it):
        for key, rows in _grouped(it):
            found = result(_Group(key[3], rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _members_worth(it):
    """A mapInArrow function: of each group, the members that are in a pair worth comparing."""
    types = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary()]
    for key, rows in _grouped(it):
        group = _Group(key[3], rows)
        at = group.worth()
        if at:
            columns = [*([v] * len(at) for v in key), *([group.rows[k][c] for k in at] for c in range(5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_KEY, "side", "rep", "comp", "n", "sig"])


def _together(members: DataFrame) -> DataFrame:
    """Members with their representatives' columns (and text, if they have one), each group in one task and together."""
    text = F.col("text") if "text" in members.columns else F.lit(None).cast("string").alias("text")
    return members.select(*_KEY, "side", "rep", "comp", "n", "sig", text).repartition("region", "i", "j").sortWithinPartitions(*_KEY)


def _compared(members: DataFrame, docs: DataFrame, tables: list) -> DataFrame:
    """Confirmed links (a, b) within groups of members (region, i, j, tree, side, rep, comp, n, sig): signatures first, texts where they are needed."""
    worth = _scratch(_together(members).mapInArrow(_members_worth, _MEMBER), "worth", tables)
    texts = texts_of(worth.select(F.col("rep").alias("node")), docs, tables).withColumnRenamed("node", "rep")
    return _together(worth.join(texts, "rep")).mapInArrow(_edges(_Group.links), "a long, b long")


def _agreeing(batch: pa.RecordBatch) -> pa.RecordBatch:
    x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(batch.num_rows, HASHES) for k in (2, 4))
    keep = _agreement(x, y, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5)))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _judged(reps: DataFrame, comps: DataFrame, tables: list) -> DataFrame:
    """Representatives with their present component."""
    named = reps.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return _scratch(named.withColumn("comp", F.coalesce("component", "rep")).drop("component"), "reps", tables)


def _likeliest(it):
    """A mapInArrow function over rows (region, rep, comp, n, sig) in sorted order: each row with the likeliest of the NEAREST before and after it
    that are in its region and in another component. Where a batch ends, the last rows meet those of the next."""
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        columns.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), ">u4").reshape(batch.num_rows, HASHES))
        if last is not None:
            columns = [np.concatenate(c) for c in zip(last, columns)]
        last = [c[-NEAREST:] for c in columns]
        region, rep, comp, n, sig = columns
        most, partner = np.zeros(len(rep)), np.full(len(rep), -1)
        for step in range(1, min(NEAREST, len(rep) - 1) + 1):
            i = np.flatnonzero((region[step:] == region[:-step]) & (comp[step:] != comp[:-step]))
            i = i[_agreement(sig[i], sig[i + step], n[i], n[i + step])]
            agree = (sig[i] == sig[i + step]).mean(1)
            for x, y in ((i, i + step), (i + step, i)):
                better = agree > most[x]
                most[x[better]], partner[x[better]] = agree[better], y[better]
        at = np.flatnonzero(partner >= 0)
        a, b = rep[at], rep[partner[at]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _within(crowded: DataFrame) -> DataFrame:
    """Candidates (a, b) of crowded regions (region, tree, rep, comp, n, sig): rows whose hashes after the region's own agree longest."""
    # a tree that grows deeper goes on with the hashes of the trees after it
    key = F.expr(f"substring(concat(sig, sig), {4 * DEPTH} * (tree + 1) + 1, {4 * ORDER_DEPTH})")
    partitions = int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = crowded.withColumn("key", key).repartitionByRange(partitions, "region", "key", "rep").sortWithinPartitions("region", "key", "rep")
    return ordered.select("region", "rep", "comp", "n", "sig").mapInArrow(_likeliest, "a long, b long").distinct()


def _open(rows: DataFrame) -> DataFrame:
    """Regions (region, m, a, b) of more than one component; a and b are the least and the greatest member."""
    regions = rows.groupBy("region").agg(F.count("*").alias("m"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    return regions.where("m > 1 and low <> high").drop("low", "high")


def _tiles(m: str, total: str) -> str:
    return f"cast(ceil(greatest(({m}) / {TILE}, ({total}) / {TILE_SHINGLES})) as int)"


def _tiled(crowded: DataFrame, tables: list) -> DataFrame:
    """Members of the pairs of tiles of those regions (region, tree, rep, comp, n, sig) that are open.

    A region that fits one tile is one. Of others, the rows of the largest component have tiles of their own, after those of all other rows, and no pair of two of these is made:
    a family of any size and the few rows that are not in it cost a number of rows that is linear in the family.
    """
    parts = crowded.groupBy("region", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    regions = parts.groupBy("region").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("total").alias("total"), F.max(F.struct("m", "total", "comp")).alias("top")).where("parts > 1")
    one = f"{_tiles('m', 'total')} = 1"
    few = f"if({one}, 1, {_tiles('m - top.m', 'total - top.total')}) as few"
    regions = _scratch(regions.selectExpr("region", "top.comp as top", few, f"if({one}, 0, {_tiles('top.m', 'top.total')}) as own"), "tiles", tables)
    placed = crowded.join(regions, "region").withColumn("large", F.expr("own > 0 and comp = top"))
    placed = placed.withColumn("tile", F.expr("cast(if(large, few + pmod(xxhash64(rep, region), own), pmod(xxhash64(rep, region), few)) as int)"))
    # the pair (i, j), i <= j, of tiles gets the rows of both; side 1 marks the second of two different tiles
    spread = F.expr("transform(sequence(0, if(large, few, few + own) - 1), o -> struct(least(o, tile) as i, greatest(o, tile) as j, if(o < tile, 1, 0) as side))")
    return placed.select("region", "tree", "rep", "comp", "n", "sig", F.explode(spread).alias("p")).select("region", "p.i", "p.j", "tree", "p.side", "rep", "comp", "n", "sig")


def _open_regions(reps: DataFrame, comps: DataFrame, docs: DataFrame, tables: list) -> DataFrame:
    """``comps`` with all that open regions add to them."""
    judged = _judged(reps, comps, tables)
    trees = f"transform(sequence(0, {TREES - 1}), t -> struct(t as tree, xxhash64(t, substring(sig, {4 * DEPTH} * t + 1, {4 * DEPTH})) as region))"
    rows = judged.select("rep", "comp", F.explode(F.expr(trees)).alias("t")).select("rep", "comp", "t.tree", "t.region")
    regions = _scratch(_open(rows), "regions", tables)
    light = judged.select("rep", "sig", "n")
    two = regions.where("m = 2").select("a", "b").distinct()
    two = two.join(light.toDF("a", "sa", "na"), "a").join(light.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(batches(_agreeing), "a long, b long")
    open_rows = rows.drop("comp").join(regions.where("m > 2").select("region", "m"), "region")
    small = open_rows.where(f"m <= {SMALL}").select("region", F.lit(0).alias("i"), F.lit(0).alias("j"), "tree", F.lit(0).alias("side"), "rep")
    pairs = two.unionAll(_together(small.join(judged, "rep")).mapInArrow(_edges(_Group.pairs), "a long, b long"))
    crowded = _scratch(open_rows.where(f"m > {SMALL}").join(judged, "rep").select("region", "tree", "rep", "comp", "n", "sig"), "crowded", tables)
    some = not crowded.isEmpty()
    if some:
        pairs = pairs.unionAll(_within(crowded))
    comps = components(_stars_of(comps).unionAll(confirmed(_scratch(pairs.distinct(), "pairs", tables), docs, tables)))
    if not some:
        return comps
    tables.append(comps)
    now = crowded.drop("comp").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    tiles = _tiled(_scratch(now, "crowded", tables), tables)
    return components(_stars_of(comps).unionAll(_compared(tiles, docs, tables)))


def _stars_of(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _linked(docs: DataFrame, tables: list) -> tuple[DataFrame, DataFrame, DataFrame, _Nodes]:
    """(rows with node, classes by print, components of nodes, names) of documents (doc_id, text); all written."""
    signed = _scratch(signatures(docs), "signed", tables)
    nodes = _Nodes(signed, tables)
    signed = nodes.named(signed)
    docs = nodes.named(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("body"), "text"))
    if nodes.repeats:  # a text is fetched once, however often its row is there
        docs = docs.select("node", "text").dropDuplicates(["node"])
    usable = signed.where("print is not null and node is not null")
    classes = _scratch(usable.groupBy("print").agg(F.min("node").alias("rep")), "classes", tables)
    reps = usable.join(classes, "print").where("node = rep").dropDuplicates(["rep"]).select("rep", "sig", F.col("n_shingles").alias("n"))
    reps = _scratch(reps, "reps", tables)
    pairs = _scratch(_deep_neighbours(reps), "pairs", tables)
    comps = components(_scratch(confirmed(pairs, docs, tables), "links", tables))
    tables.append(comps)
    return signed, classes, _open_regions(reps, comps, docs, tables), nodes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row for each input row."""
    tables: list[DataFrame] = []
    signed, classes, comps, nodes = _linked(docs.select("doc_id", "text"), tables)
    tables.append(comps)
    named = signed.join(classes, "print", "left").withColumn("node", F.coalesce("rep", "node"))
    if nodes.some:  # rows that share a doc_id are one node: link them, then name each component by its least doc_id
        shared = named.join(_near(nodes.several, nodes.few), F.col("doc_id") == F.col("several")).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
        comps = components(_stars_of(comps).unionAll(shared))
        tables.append(comps)
        least = named.where("doc_id is not null").join(comps, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
        comps = comps.join(least, "component").select("node", F.col("least").alias("component"))
    out = named.join(comps, "node", "left").withColumn("component_id", F.least(F.coalesce("component", "node"), "doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return done(out, "groups", tables)


def without_near_duplicates(docs: DataFrame, broadcast_ids: int = 500_000) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id, all columns as they are; one of rows with the same doc_id and text."""
    tables: list[DataFrame] = []
    signed, classes, comps, _ = _linked(docs.select("doc_id", "text"), tables)
    tables.append(comps)
    rows = signed.where("doc_id is not null").join(classes, "print", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    rows = _scratch(rows.select("doc_id", "body", F.coalesce("component", "rep").alias("component")).where("component is not null"), "rows", tables)
    # written first: a join with a table, not with the aggregate's own partitions, lets Spark split the rows of a large group
    best = _scratch(rows.groupBy("component").agg(F.min(F.struct("doc_id", "body")).alias("best")), "best", tables)
    gone = rows.join(best, "component").where(F.struct("doc_id", "body") != F.col("best")).select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")).distinct()
    gone = _scratch(gone, "gone", tables)
    again = _scratch(signed.where("doc_id is not null").groupBy("doc_id", "body").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("again_id"), F.col("body").alias("again_body")), "again", tables)
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    key, body = F.col(at["doc_id"]), F.xxhash64(at["text"])
    for t in tables:
        if t is not gone and t is not again:
            forget(t)
    n = gone.count()
    kept = plain.join(_near(gone, n <= broadcast_ids), (key == F.col("gone_id")) & (body == F.col("gone_body")), "left_anti")
    n = again.count()
    if n:
        again, same = _near(again, n <= broadcast_ids), (key == F.col("again_id")) & (body == F.col("again_body"))
        row = F.struct(*plain.columns)
        once = kept.join(again, same, "left_semi").groupBy(key.alias("k"), body.alias("b")).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        kept = kept.join(again, same, "left_anti").unionAll(once)
    return kept.toDF(*docs.columns)


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) end as sh
  from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
u as (select doc_id, md5(x) as x from (select doc_id, unnest(sh) as x from s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * k >= 75 * (na.n_shingles + nb.n_shingles - k)),
e as (select a, b from l union select b, a from l),
r(node, reach) as (select doc_id, doc_id from n union select r.node, e.b from r join e on e.a = r.reach),
c as (select node, min(reach) as component_id from r group by 1)
select n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c on c.node = n.doc_id
"""
