"""The trail network as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.geo import cell, cell_id, haversine, node_key
from cairn.functions.session import kept, rounds
from cairn.operators.components import connected_components
from cairn.operators.lines import vertex_pairs
from cairn.operators.spatial import near_points, nearest

MERGE_M, MERGE_UNITS = 4.0, 4
BRIDGE_M, BRIDGE_CELL, BRIDGE_NODES = 50.0, 0.0005, 3
SNAP_M, RETRY_M, SNAP_K = 300.0, 500.0, 6


def nodes_of(vertices: DataFrame, key: str = "osm_id") -> DataFrame:
    """(node, lng, lat, seen): one row of each node key, placed at its first vertex in order of (key, pos)."""
    first = F.min(F.struct(F.col(key).alias("k"), "pos", "lng", "lat"))
    each = vertices.groupBy(node_key("lng", "lat").cast("long").alias("node")).agg(first.alias("f"))
    return each.select("node", F.col("f.lng").cast("double").alias("lng"), F.col("f.lat").cast("double").alias("lat"), F.struct("f.k", "f.pos").alias("seen"))


def close_nodes(nodes: DataFrame) -> DataFrame:
    """JOIN-10: (later, earlier, dist) of node pairs within 4 m and 4 units of the key on each axis."""
    size = MERGE_UNITS * 1e-5
    a = nodes.select(F.col("node").alias("later"), "lng", "lat", F.col("seen").alias("s"))
    b = nodes.select(F.col("node").alias("earlier"), F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat"), F.col("seen").alias("t"))
    near = near_points(a, b, MERGE_M, size=size)
    units = (F.abs(F.col("lng") - F.col("other_lng")) <= size + 1e-9) & (F.abs(F.col("lat") - F.col("other_lat")) <= size + 1e-9)
    return near.filter(units & (F.col("t") < F.col("s"))).select("later", "earlier", "dist")


def merged(nodes: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """GRF-2: (node, leader), greedy in order of first sight: the nearest leader within reach, or a leader itself.

    A node is decided once all its earlier neighbours are, so the rounds are as many as the
    longest chain of close nodes; an error is raised where max_rounds are too few.
    """
    pairs = kept(close_nodes(nodes))
    waiting = pairs.select(F.col("later").alias("node")).distinct()
    done = kept(nodes.select("node").join(waiting, "node", "left_anti").select("node", F.col("node").alias("leader")))
    left = kept(waiting)
    for _ in rounds(max_rounds):
        if left.isEmpty():
            break
        open_ = pairs.join(left.select(F.col("node").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("node")).distinct()
        ready = left.join(open_, "node", "left_anti")
        to = pairs.join(done.filter("node = leader").select(F.col("node").alias("earlier")), "earlier").groupBy(F.col("later").alias("node")).agg(F.min_by("earlier", F.struct("dist", "earlier")).alias("leader"))
        now = kept(ready.join(to, "node", "left").select("node", F.coalesce("leader", "node").alias("leader")))
        done, left = kept(done.unionAll(now)), kept(left.join(now, "node", "left_anti"))
    return done


def edges_of(vertices: DataFrame, leaders: DataFrame, key: str = "osm_id") -> DataFrame:
    """GRF-1: (feature, pos, a, b, weight) with the raw segment's length; segments within one node go."""
    s = vertex_pairs(vertices, key).select(F.col(key).alias("feature"), "pos", node_key("ax", "ay").cast("long").alias("p"), node_key("bx", "by").cast("long").alias("q"), haversine("ax", "ay", "bx", "by").alias("weight"))
    joined = s.join(leaders.toDF("p", "a"), "p").join(leaders.toDF("q", "b"), "q")
    return joined.filter("a <> b").select("feature", "pos", "a", "b", "weight")


def least_edges(vertices: DataFrame, leaders: DataFrame, key: str = "osm_id") -> DataFrame:
    """(a, b, weight): edges_of() for those who need no features: of segments over the same two nodes the shortest, taken before they meet the leaders."""
    s = vertex_pairs(vertices, key).select(node_key("ax", "ay").cast("long").alias("p"), node_key("bx", "by").cast("long").alias("q"), haversine("ax", "ay", "bx", "by").alias("weight"))
    one = s.groupBy("p", "q").agg(F.min("weight").alias("weight"))
    joined = one.join(leaders.toDF("p", "a"), "p").join(leaders.toDF("q", "b"), "q")
    return joined.filter("a <> b").select("a", "b", "weight")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Both directions, of parallel edges the shortest: (edge, a, b, weight); edge is the same both ways."""
    low = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    one = low.groupBy("a", "b").agg(F.min("weight").alias("weight")).withColumn("edge", F.xxhash64("a", "b"))
    return one.select("edge", "a", "b", "weight").unionAll(one.select("edge", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-3: (node, lng, lat, component, size), before any bridge."""
    comp = connected_components(edges, "a", "b")
    own = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("component").agg(F.count("*").alias("size"))
    return own.join(sizes, "component").select("node", "lng", "lat", "component", "size")


def bridges(nodes: DataFrame) -> DataFrame:
    """JOIN-11, GRF-4: (a, b, weight), for each pair of components of three nodes or more its closest nodes within 50 m.

    Nodes are met in neighbouring cells of 0.0005 degrees.
    """
    big = nodes.filter(F.col("size") >= BRIDGE_NODES)
    around = F.sequence(F.lit(-1), F.lit(1))
    a = big.select(F.col("node").alias("a"), "lng", "lat", F.col("component").alias("ca")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    a = a.withColumn("cell", cell_id(cell("lng", BRIDGE_CELL) + F.col("dx"), cell("lat", BRIDGE_CELL) + F.col("dy")))
    b = big.select(F.col("node").alias("b"), F.col("lng").alias("blng"), F.col("lat").alias("blat"), F.col("component").alias("cb"), cell_id(cell("lng", BRIDGE_CELL), cell("lat", BRIDGE_CELL)).alias("cell"))
    near = a.join(b, "cell").filter("ca < cb").withColumn("weight", haversine("lng", "lat", "blng", "blat"))
    best = near.groupBy("ca", "cb").agg(F.min(F.struct("weight", "a", "b")).alias("m"))
    return best.select("m.a", "m.b", "m.weight").filter(F.col("weight") <= BRIDGE_M)


def snap(points: DataFrame, nodes: DataFrame, metres: float = SNAP_M, k: int = SNAP_K) -> DataFrame:
    """GRF-5: (columns of points, node, dist, rank): the k nearest nodes; points has point, lng, lat."""
    held = nodes.select("node", F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat"))
    return nearest(near_points(points, held, metres), "point", k, "node").drop("other_lng", "other_lat")


def least_component(nodes: DataFrame) -> DataFrame:
    """AGG-8: the largest component and the size below which a retry ignores components."""
    return nodes.agg(F.max("size").alias("largest"), F.greatest(F.lit(10), F.floor(F.max("size") * 0.05)).alias("least"))
