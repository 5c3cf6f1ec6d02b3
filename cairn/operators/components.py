"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.session import kept, rounds


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours (large: the larger ones; small: the smaller ones and itself) go to its least neighbour."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, for every node that an edge names.

    Edges are pairs of longs in columns u and v, in any direction; edges with a null end are
    left out, repeats and loops do no harm, and an empty table gives an empty one.  Only counts
    come to the driver.
    """
    both = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna()
    loops = both.filter("u = v").select(F.col("u").alias("node"))
    now = kept(both.filter("u <> v").distinct())
    before = None
    for _ in rounds(max_rounds):
        now = kept(_star(_star(now, large=True), large=False))
        # Both steps only ever lower the far end of an edge: equal sums mean nothing moved.
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    alone = loops.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionAll(alone)
