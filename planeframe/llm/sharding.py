"""Sharding by longest-processing-time scheduling: groups of equal texts stay together, larger groups first, each to the least-loaded shard of a heap.

Groups that are equally large are interchangeable, so the driver runs the heap over a histogram of group sizes
and deals each size's groups in bulk: while the shards' loads differ by more than one group, the lowest shard takes what levels it,
after that all shards take one each in turn, exactly as popping the heap one by one would. Sizes of 4096 bytes and more
are taken in classes of 12 binary places (0.03 % wide) at their mean, which bounds the histogram at 4096 rows for each
power of two, whatever the input; with ``places=None`` every size is a class of its own and the plan is the heap's to the byte, for inputs whose distinct group sizes fit the driver.
A shard's load differs from the exact plan's by at most what one group of each class it meets differs from the class's mean, 0.03 % of its bytes. Groups find their place by their rank in their class, counted over hash buckets, so no
task and not the driver ever sees all groups.

Edge cases: a null text is a group of its own and counts no text bytes; repeated rows are equal texts and share their shard;
a group larger than a shard's fair part fills its shard alone; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import done, table, written

SHARDS = 8
PLACES = 12
BUCKETS = 1024


def lpt_plan(sizes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, list[int]]]:
    """[(class, groups, bytes)] -> [(class, from rank, to rank, shards dealt in turn)] by the heap of (load, shard)."""
    heap = [(0.0, i) for i in range(shards)]
    plan = []
    for kind, n, total in sorted(sizes, reverse=True):
        each, at = total / n, 0
        while at < n:
            load, i = heap[0]
            if n - at >= shards and max(heap)[0] - load <= each:
                turns = (n - at) // shards
                heap.sort()
                plan.append((kind, at, at + turns * shards, [j for _, j in heap]))
                heap = [(x + turns * each, j) for x, j in heap]
                at += turns * shards
            else:
                level = min(heap[1:3])[0] if shards > 1 else float("inf")
                k = n - at if shards == 1 else max(1, min(n - at, int((level - load) / each)))
                plan.append((kind, at, at + k, [i]))
                heapq.heapreplace(heap, (load + k * each, i))
                at += k
    return plan


def _ranked(df: DataFrame, by: str, order: list[str], rank: str) -> DataFrame:
    """Adds a gapless rank from 0 within ``by``, counted over hash buckets so that no task holds a whole group."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = df.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    df = df.withColumn(rank, F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1)
    return df.join(before, [by, "_bucket"]).withColumn(rank, F.col(rank) + F.coalesce("_before", F.lit(0))).drop("_bucket", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, places: int | None = PLACES) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each input row."""
    spark = docs.sparkSession
    tables: list[DataFrame] = []
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), F.unhex(F.lit("00"))).alias("key"),
    )
    base = written(base, "sizes")
    tables.append(base)
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    low = F.lit(0) if places is None else F.greatest(F.length(F.bin("bytes")) - F.lit(places), F.lit(0))
    groups = groups.withColumn("low", low).withColumn("kind", F.expr("shiftleft(shiftright(bytes, low), low)")).drop("low")
    groups = written(groups, "groups")
    tables.append(groups)
    sizes = [tuple(r) for r in groups.groupBy("kind").agg(F.count("*"), F.sum("bytes")).collect()]
    plan: dict[int, list] = {}
    for kind, lo, hi, turn in lpt_plan(sizes, shards):
        plan.setdefault(kind, []).append((lo, hi, turn))
    rules = spark.createDataFrame(list(plan.items()), "kind long, rules array<struct<lo:long,hi:long,turn:array<int>>>")
    ranked = _ranked(groups, "kind", ["key"], "rank").join(F.broadcast(rules), "kind")
    rule = F.expr("filter(rules, r -> rank >= r.lo and rank < r.hi)[0]")
    placed = ranked.withColumn("rule", rule).select("key", F.expr("element_at(rule.turn, cast((rank - rule.lo) % size(rule.turn) as int) + 1)").alias("shard"))
    rows = _ranked(base.join(placed, "key"), "shard", ["doc_id", "key"], "slot")
    out = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return done(out, "shards", tables)


def op10_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
