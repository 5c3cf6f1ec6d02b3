"""Searches in components of the network that fit in a task: Spark deals components and what is asked of them into groups, and each group answers for itself."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.session import landed
from cairn.operators.components import connected_components
from cairn.operators.routes import CARRIED, MOST, PENALTY, SHARED, further

#: Edges of a component, both ways counted, up to which it is searched in a task; larger ones go by the rounds of routes.spread().
LOCAL = 4096
#: Edges of the components of one group, about.
GROUP = 4096
STEP = pa.struct([("edge", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])
Steps = tuple[tuple[int, int, int], ...]

# What tasks run goes to the workers as a whole, and not by the name of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Dealt:
    """The network's small components: edges (bucket, edge, a, b, weight, n) and nodes (node, bucket); whether there are larger ones."""

    edges: DataFrame
    nodes: DataFrame
    others: bool


def dealt(net: DataFrame, members: DataFrame | None = None) -> Dealt:
    """net (edge, a, b, weight, n), both ways, by components; members (node, component) where they are known."""
    members = connected_components(net.filter("a < b"), "a", "b") if members is None else members.select("node", "component")
    each = net.join(members.withColumnRenamed("node", "a"), "a")
    sizes = landed(each.groupBy("component").agg(F.count("*").alias("size")))
    small = F.col("size") <= LOCAL
    rows, others = sizes.agg(F.sum(F.when(small, F.col("size"))), F.max((~small).cast("int"))).first()
    buckets = max(1, -(-(rows or 0) // GROUP))
    held = each.join(sizes.filter(small), "component").withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int"))
    edges = landed(held.select("bucket", "edge", "a", "b", "weight", "n"))
    return Dealt(edges, landed(edges.select(F.col("a").alias("node"), "bucket").distinct()), bool(others))


def spread_within(net: dict[int, list], source: int, target: int, dear: set[int]) -> tuple[float, float, Steps] | None:
    """(cost, length, steps) of the path that routes.spread() finds from one source to one target, with its rule for equal costs."""
    held = {source: (0.0, 0.0, (), None)}
    fresh = [source]
    while fresh:
        bound = held[target][0] if target in held else float("inf")
        came: dict[int, tuple] = {}
        for node in fresh:
            cost, length, tail, base = held[node]
            if cost >= bound:
                continue
            if base is None or len(tail) == CARRIED:
                base, tail = node, ()
            for b, edge, weight, n in net.get(node, ()):
                far = cost + (weight * PENALTY if edge in dear else weight), length + weight
                if b in held and far >= held[b][:2]:
                    continue
                if b not in came or far <= came[b][:2]:
                    new = (*far, (*tail, (edge, n, b)), base)
                    came[b] = min(new, came.get(b, new))
        held |= came
        fresh = list(came)
    if target not in held:
        return None
    cost, length, steps, base = held[target]
    while base != source:
        _, _, head, base = held[base]
        steps = head + steps
    return cost, length, steps


def ways_within(net: dict[int, list], source: int, target: int, used: Iterable[int] = (), most: int = MOST) -> list[tuple[float, float, Steps]]:
    """The routes of routes.further(), which avoid used from the start."""
    dear, found = set(used), []
    while source != target and len(found) < most:
        new = spread_within(net, source, target, dear)
        if new is None:
            break
        if found:
            first, steps = found[0][2], new[2]
            own = {e for e, _, _ in first}
            if sum(n for e, n, _ in steps if e in own) / max(sum(n for _, n, _ in first), sum(n for _, n, _ in steps)) >= SHARED:
                break
        found.append(new)
        dear.update(e for e, _, _ in new[2])
    return found


def adjacent(edges: pa.Table) -> dict[int, list]:
    net: dict[int, list] = {}
    for a, *rest in zip(*(edges.column(c).to_pylist() for c in ("a", "b", "edge", "weight", "n")), strict=True):
        net.setdefault(a, []).append(tuple(rest))
    return net


def steps_array(paths: list[Steps]) -> pa.Array:
    ends = [0]
    for p in paths:
        ends.append(ends[-1] + len(p))
    parts = zip(*(s for p in paths for s in p), strict=True) if ends[-1] else ((), (), ())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], fields=list(STEP)))


def paths_of(column: pa.ChunkedArray) -> list[Steps]:
    """The steps of each row of a column of steps."""
    out: list[Steps] = []
    for chunk in column.chunks:
        flat, ends = chunk.flatten(), chunk.offsets.to_pylist()
        steps = list(zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True))
        out += [tuple(steps[i - ends[0] : j - ends[0]]) for i, j in zip(ends, ends[1:], strict=False)]
    return out


def answered(requests: DataFrame, net: DataFrame, parts: Dealt, most: int = MOST) -> DataFrame:
    """(request, source, cost, length, steps, alt): routes.further() for requests (request, source, target), in groups where components are small."""

    def run(asked: pa.Table, edges: pa.Table) -> pa.Table:
        around, rows, found = adjacent(edges), [], []
        for i, (s, t) in enumerate(zip(asked.column("source").to_pylist(), asked.column("target").to_pylist(), strict=True)):
            ways = ways_within(around, s, t, (), most)
            rows += [(i, alt) for alt in range(len(ways))]
            found += ways
        ids = asked.select(["request", "source"]).take(pa.array([i for i, _ in rows], pa.int64()))
        columns = [pa.array([w[k] for w in found], pa.float64()) for k in (0, 1)] + [steps_array([w[2] for w in found]), pa.array([alt for _, alt in rows], pa.int32())]
        return pa.Table.from_arrays([*ids.columns, *columns], ["request", "source", "cost", "length", "steps", "alt"])

    asked = requests.select("request", "source", "target")
    types = asked.schema
    schema = f"request {types['request'].dataType.simpleString()}, source bigint, cost double, length double, steps array<struct<edge: bigint, n: bigint, node: bigint>>, alt int"
    own = asked.join(parts.nodes.withColumnRenamed("node", "source"), "source").select("bucket", "request", F.col("source").cast("long"), F.col("target").cast("long"))
    out = own.groupBy("bucket").cogroup(parts.edges.groupBy("bucket")).applyInArrow(run, schema)
    if not parts.others:
        return out
    rest = landed(asked.join(parts.nodes.withColumnRenamed("node", "source"), "source", "left_anti"))
    return out.unionByName(further(rest, net, most).select(*out.columns))


def carried_on(ways: DataFrame, parts: Dealt, leg: int, most: int) -> DataFrame:
    """ways (bucket, own, places, branch, steps, length, ...) with a further leg: up to MOST that avoid what a way has used; of one own the first most by branch.

    Ways that have no more legs stay.  Ways of one group that have used the same edges and go on alike are searched once.
    """

    def run(held: pa.Table, edges: pa.Table) -> pa.Table:
        around, known = adjacent(edges), {}
        paths, lengths = paths_of(held.column("steps")), held.column("length").to_pylist()
        places, branches, owners = (held.column(c).to_pylist() for c in ("places", "branch", "own"))
        order = sorted(range(len(paths)), key=lambda i: (owners[i], branches[i]))
        rows = []
        for _, own in groupby(order, key=lambda i: owners[i]):
            mine = []
            for i in own:
                if len(mine) >= most:
                    break
                if len(places[i]) <= leg:
                    mine.append((i, branches[i], paths[i], lengths[i]))
                    continue
                ask = places[i][leg - 1], places[i][leg], frozenset(e for e, _, _ in paths[i])
                if ask not in known:
                    known[ask] = ways_within(around, *ask)
                mine += [(i, [*branches[i], alt], paths[i] + steps, lengths[i] + length) for alt, (_, length, steps) in enumerate(known[ask])]
            rows += mine[:most]
        out = held.take(pa.array([r[0] for r in rows], pa.int64()))
        new = {"branch": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "steps": steps_array([r[2] for r in rows]), "length": pa.array([r[3] for r in rows], pa.float64())}
        return pa.Table.from_arrays([new.get(c, out.column(c)) for c in out.column_names], out.column_names)

    return ways.groupBy("bucket").cogroup(parts.edges.groupBy("bucket")).applyInArrow(run, ways.schema)
