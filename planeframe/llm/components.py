"""Connected components of a link table by alternating large-star and small-star contraction.

Every step is a partially aggregated minimum and an equi-join, so a hub with millions of links is
spread by the map-side combine and by adaptive skew-join splitting. Each round is written to the
shared folder; the driver sees two numbers a round and never a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least2 = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least2, "a")
    moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs, in any order, repeated or reflexive -> (node, component): the smallest reachable node.

    Null ends are ignored; nodes without a link to another node do not appear.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None and tuple(new) == state or not new[0]:
            break
        state = tuple(new)
        after = written(_stars(now), "cc")
        forget(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
