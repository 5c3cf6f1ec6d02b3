"""Routes for tables of requests, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import bearing, between, haversine
from cairn.functions.session import Turns, landed, rounds

PENALTY, SHARED = 8.0, 0.7
MOST = 4
#: Steps of a path that a node of the search carries; longer ones are put together of parts.
CARRIED = 16
STEPS = "array<struct<edge: bigint, n: bigint, node: bigint>>"
NET = ["edge", "a", "b", "weight", "n"]


def contracted(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The network (edge, a, b, weight, n) in which each chain of nodes of two neighbours is one edge of n, and the chains.

    edges is (edge, a, b, weight) in both directions, without parallel edges; ends has node,
    those that a route may begin, pass or end at, which stay.  The chains (edge, node, rank, own, stop)
    list the edges that an edge towards node is made of, the last one first.  Chains are followed
    by doubling: after k rounds each edge knows what lies 2**k on, so the rounds are as many as
    the logarithm of the longest chain.  Rings without a junction, and chains back to where they
    began, are on no shortest route and left out.
    """
    ends = ends.select("node").distinct()
    # A node of two edges goes on from each over the other, so the edges meet their nodes once and not each other.
    two = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d"), F.min("edge").alias("low"), F.max("edge").alias("high")).filter("d = 2").drop("d")
    plain = landed(two.join(ends, "node", "left_anti"))
    other = F.when(F.col("low") != F.col("high"), F.when(F.col("edge") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    ahead = edges.join(plain.withColumnRenamed("node", "b"), "b", "left").withColumn("next", other)
    now = ahead.select("edge", "a", "weight", F.lit(1).cast("long").alias("n"), F.col("b").alias("end"), F.col("edge").alias("last"), "next", F.when(F.col("next").isNotNull(), F.col("b")).alias("at"), F.col("b").alias("stop"))
    open_ = None
    turns = Turns(edges.sparkSession)
    while True:
        now = turns.keep(now)
        left = now.filter("next is not null").count()
        if not left or left == open_:  # what no round ends is a ring
            break
        open_ = left
        on = now.select(F.col("edge").alias("next"), F.col("a").alias("at"), F.col("weight").alias("w"), F.col("n").alias("m"), F.col("end").alias("e"), F.col("last").alias("l"), F.col("next").alias("nn"), F.col("at").alias("na"))
        went = now.filter("next is not null").join(on, ["next", "at"]).select("edge", "a", (F.col("weight") + F.col("w")).alias("weight"), (F.col("n") + F.col("m")).alias("n"), F.col("e").alias("end"), F.col("l").alias("last"), F.col("nn").alias("next"), F.col("na").alias("at"), "stop")
        now = now.filter("next is null").unionAll(went)
    whole = now.filter("next is null")
    first = whole.join(plain.select(F.col("node").alias("a")), "a", "left_anti").filter(F.col("a") != F.col("end"))
    name = F.when(F.col("n") == 1, F.col("edge")).otherwise(F.xxhash64(F.least("edge", "last"), F.greatest("edge", "last")))
    first = landed(first.withColumn("name", name))
    net = first.select(F.col("name").alias("edge"), "a", F.col("end").alias("b"), "weight", "n")
    members = whole.select("edge", "n", "end", "last", "stop").join(first.select("name", "end", "last"), ["end", "last"])
    return net, members.select(F.col("name").alias("edge"), F.col("end").alias("node"), F.col("n").alias("rank"), F.col("edge").alias("own"), "stop")


def uncontracted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("n", F.lit(1).cast("long")).select(*NET)


def unpacked(routes: DataFrame, chains: DataFrame | None) -> DataFrame:
    """Routes with path as edges before contraction (array of long) and stops, the nodes from the source on; other columns stay."""
    if chains is None:
        return routes.withColumns({"path": F.col("steps.edge"), "stops": F.concat(F.array("source"), F.col("steps.node"))}).drop("steps", "source")
    routes = landed(routes.withColumn("row", F.xxhash64(*(c for c in routes.columns if c != "steps"), F.col("steps"))))
    each = routes.select("row", F.posexplode("steps").alias("i", "step")).select("row", "i", "step.edge", "step.node").distinct()
    parts = each.join(chains, ["edge", "node"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("rank")).alias("rank"), "own", "stop"))).alias("parts"))
    return routes.join(parts, "row").withColumns({"path": F.col("parts.own"), "stops": F.concat(F.array("source"), F.col("parts.stop"))}).drop("row", "parts", "steps", "source")


def search(requests: DataFrame, net: DataFrame, penalties: DataFrame | None = None, max_rounds: int | None = None, every: int = 4) -> DataFrame:
    """(request, source, cost, length, steps) of the cheapest path of each (request, source, target) over a network.

    source = target gives no route.  See spread().
    """
    asked = landed(requests.filter("source <> target").select("request", "source", "target"))
    return spread(asked.select("request", "source"), asked.select("request", F.col("target").alias("node")), net, penalties, max_rounds, every).drop("target")


def spread(starts: DataFrame, goals: DataFrame, net: DataFrame, penalties: DataFrame | None = None, max_rounds: int | None = None, every: int = 4) -> DataFrame:
    """(request, source, target, cost, length, steps): the cheapest path of each request from any of its starts (request, source) to its goals (request, node).

    Of several goals the one that costs least is right, and what another one has may be no path
    of least cost.  No node is a start and a goal of one request; rows do not repeat.

    penalties (request, edge, factor) multiplies weights (JOIN-23); length is without them.  Each
    round relaxes the edges of the nodes improved in the last one; nodes that already cost more
    than a found goal are left.  Equal costs go to the shorter path, then to the smaller source,
    then to the smaller path.

    A node carries the last steps of its path, CARRIED at most, and the node that they begin at;
    so a row's size is bounded, and a longest path takes a join for each CARRIED steps at the end.
    """
    goals = goals.withColumn("goal", F.lit(True))
    penalties = None if penalties is None else landed(penalties)
    state = starts.select("request", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("length"), F.lit(None).cast("long").alias("base"), F.array().cast(STEPS).alias("tail"), F.lit(True).alias("fresh"))
    columns, turns = state.columns, Turns(state.sparkSession)
    for n in rounds(max_rounds):
        # Each row stays, and a fresh one goes on over its edges too: the state is read once a round.
        each = state.join(net, (F.col("node") == F.col("a")) & F.col("fresh"), "left")
        price = F.col("weight")
        if penalties is not None:
            each = each.join(penalties, ["request", "edge"], "left")
            price = price * F.coalesce("factor", F.lit(1.0))
        full = (F.size("tail") == CARRIED) | F.col("base").isNull()
        one = F.array(F.struct("edge", F.col("n").cast("long").alias("n"), F.col("b").alias("node")))
        base, tail = F.when(full, F.col("node")).otherwise(F.col("base")), F.when(full, one).otherwise(F.concat("tail", one))
        stays = F.struct("node", "cost", "length", "source", F.lit(False).alias("fresh"), "tail", "base")
        goes = F.struct(F.col("b").alias("node"), (F.col("cost") + price).alias("cost"), (F.col("length") + F.col("weight")).alias("length"), "source", F.lit(True).alias("fresh"), tail.alias("tail"), base.alias("base"))
        both = each.select("request", F.explode(F.when(F.col("b").isNull(), F.array(stays)).otherwise(F.array(stays, goes))).alias("x")).select("request", "x.*")
        state = both.groupBy("request", "node").agg(F.min(F.struct("cost", "length", "source", "fresh", "tail", "base")).alias("m")).select("request", "m.source", "node", "m.cost", "m.length", "m.base", "m.tail", "m.fresh")
        if n % every == every - 1:
            reached = state.join(goals, ["request", "node"], "left").withColumn("bound", F.min(F.when(F.col("goal"), F.col("cost"))).over(Window.partitionBy("request")))
            state = turns.keep(reached.withColumn("fresh", F.col("fresh") & (F.col("bound").isNull() | (F.col("cost") < F.col("bound")))).select(columns))
            if state.filter("fresh").isEmpty():
                break
    found = state.join(goals, ["request", "node"]).select("request", "source", F.col("node").alias("target"), "cost", "length", "base", F.col("tail").alias("steps"))
    found = landed(found)
    far = found.filter("base <> source")
    while not far.isEmpty():
        earlier = state.select("request", F.col("node").alias("base"), F.col("base").alias("before"), F.col("tail").alias("head"))
        far = landed(far.join(earlier, ["request", "base"]).select("request", "source", "target", "cost", "length", F.col("before").alias("base"), F.concat("head", "steps").alias("steps")))
        found = found.filter("base = source").unionAll(far)
        found = landed(found)
        far = found.filter("base <> source")
    return found.drop("base")


def shortest(requests: DataFrame, edges: DataFrame, penalties: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """GRF-6: (request, cost, length, path, stops) of the cheapest path of each (request, source, target) over edges (edge, a, b, weight).

    Without penalties the chains of the graph are one edge each, so the rounds of the search are
    bound by the junctions on a route.  Penalties (request, edge, factor) are on edges as they are.
    """
    if penalties is not None:
        return unpacked(search(requests, uncontracted(edges), penalties, max_rounds), None).select("request", "cost", "length", "path", "stops")
    net, chains = contracted(edges, ends_of(requests))
    return unpacked(search(requests, net, None, max_rounds), chains).select("request", "cost", "length", "path", "stops")


def ends_of(requests: DataFrame, *columns: str) -> DataFrame:
    """(node) of all places that requests name."""
    out = None
    for c in columns or ("source", "target"):
        part = requests.select(F.col(c).alias("node"))
        out = part if out is None else out.unionAll(part)
    return out


def shared(one: DataFrame, other: DataFrame) -> DataFrame:
    """AGG-10: (request, shared): steps of other on edges of one, over the longer of the two."""
    both = one.select("request", F.col("path").alias("p")).join(other.select("request", F.col("path").alias("q")), "request")
    n = F.size(F.filter("q", lambda e: F.array_contains("p", e)))
    return both.select("request", (n / F.greatest(F.size("p"), F.size("q"))).alias("shared"))


def steps_in(steps: Column) -> Column:
    """Edges before contraction in an array of steps."""
    return F.aggregate(steps, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])


def share(one: Column, other: Column) -> Column:
    """The same as AGG-10 for arrays of steps."""
    edges = F.transform(one, lambda x: x["edge"])
    both = steps_in(F.filter(other, lambda x: F.array_contains(edges, x["edge"])))
    return both / F.greatest(steps_in(one), steps_in(other))


def penalised(*routes: DataFrame) -> DataFrame:
    """(request, edge, factor) of all edges of the network on the routes."""
    used = routes[0].select("request", F.explode("steps.edge").alias("edge"))
    for r in routes[1:]:
        used = used.unionAll(r.select("request", F.explode("steps.edge").alias("edge")))
    return used.distinct().withColumn("factor", F.lit(PENALTY))


def further(requests: DataFrame, net: DataFrame, most: int = MOST, before: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """(request, source, cost, length, steps, alt): GRF-9 over a network.

    before (request, edge, factor) are edges to avoid from the start; first is what search() gives, where that is known.
    """
    first = search(requests, net, before) if first is None else first
    found = [first.withColumn("alt", F.lit(0))]
    active, routes = requests, [first]
    for alt in range(1, most):
        active = landed(active.join(routes[-1].select("request"), "request", "left_semi"))
        if active.isEmpty():
            break
        used = penalised(*routes)
        new = search(active, net, used if before is None else used.unionByName(before).distinct())
        apart = new.join(first.select("request", F.col("steps").alias("p")), "request").filter(share(F.col("p"), F.col("steps")) < SHARED)
        new = landed(apart.drop("p"))
        found.append(new.withColumn("alt", F.lit(alt)))
        routes.append(new)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def alternatives(requests: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """GRF-9: up to four routes (request, alt, cost, length, path, stops): each new one avoids all edges used so far, and the first that shares 0.7 or more with the first ends the search."""
    from cairn.operators.near_routes import answered, dealt  # which needs further()

    net, chains = contracted(edges, ends_of(requests))
    net = landed(net)
    return unpacked(answered(requests, net, dealt(net), most), chains)


def best_snapped(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-7: (request, length, source, target, path, stops) of the shortest path from any source to any target of a request.

    sources and targets are (request, node).  All sources of a request are searched from at once;
    only where a node is a source and a target, each pair is one request of GRF-6.
    """
    own = lambda df, other: df.select("request", "node").distinct().join(other.select("request").distinct(), "request", "left_semi")
    starts, goals = landed(own(sources, targets)), landed(own(targets, sources))
    both = landed(starts.join(goals, ["request", "node"], "left_semi").select("request").distinct())
    net, chains = contracted(edges, starts.unionAll(goals).select("node"))
    from_, to = (df.join(both, "request", "left_anti") for df in (starts, goals))
    found = spread(landed(from_.select("request", F.col("node").alias("source"))), landed(to), net)
    if not both.isEmpty():
        pairs = starts.join(both, "request").withColumnRenamed("node", "source").join(goals.withColumnRenamed("node", "target"), "request").filter("source <> target")
        asked = landed(pairs.select(F.col("request").alias("own"), "source", "target", F.xxhash64("request", "source", "target").alias("request")))
        each = search(asked.select("request", "source", "target"), net).join(asked.select("request", "own", "target"), "request")
        found = found.unionByName(each.drop("request").withColumnRenamed("own", "request"))
    # Of the routes of a request the least by (length, source, target) is the only one of its ends.
    best = found.groupBy("request").agg(F.min(F.struct("length", "source", "target", "steps")).alias("m")).select("request", "m.*")
    return unpacked(best.withColumn("from", F.col("source")), chains).select("request", "length", F.col("from").alias("source"), "target", "path", "stops")


def round_trip(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-13: (request, out_length, back_length, only_one_path): the way back avoids the way out."""
    net, _ = contracted(edges, ends_of(requests))
    out = search(requests, net)
    turned = requests.select("request", F.col("target").alias("source"), F.col("source").alias("target"))
    back = search(turned, net, penalised(out))
    both = out.select("request", F.col("length").alias("out_length"), F.col("steps").alias("p")).join(back.select("request", F.col("length").alias("back_length"), F.col("steps").alias("q")), "request")
    return both.select("request", "out_length", "back_length", (share(F.col("p"), F.col("q")) > SHARED).alias("only_one_path"))


def through(requests: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """GRF-10: up to four routes (request, alt, length, path, stops) through via: alternatives of both legs combined (JOIN-25), shortest first, each sharing under 0.7 with all kept before (WIN-12)."""
    net, chains = contracted(edges, ends_of(requests, "source", "via", "target"))
    legs = requests.select("request", F.lit(0).alias("leg"), "source", F.col("via").alias("target")).unionAll(requests.select("request", F.lit(1), F.col("via"), "target"))
    legs = landed(legs.withColumn("own", F.col("request")).withColumn("request", F.xxhash64("own", "leg")))
    alts = further(legs.select("request", "source", "target"), net).join(legs.select("request", "own", "leg"), "request")
    return unpacked(few_diverse(leg_pairs(alts), most), chains)


def leg_pairs(alts: DataFrame) -> DataFrame:
    """JOIN-25: (request, source, length, steps): each alternative of the first leg with each of the second; alts has own, leg, source, length, steps."""
    a = alts.filter("leg = 0").select(F.col("own").alias("request"), "source", F.col("steps").alias("p"), F.col("length").alias("x"))
    b = alts.filter("leg = 1").select(F.col("own").alias("request"), F.col("steps").alias("q"), F.col("length").alias("y"))
    return a.join(b, "request").select("request", "source", (F.col("x") + F.col("y")).alias("length"), F.concat("p", "q").alias("steps"))


def diverse(left: DataFrame, most: int = MOST) -> DataFrame:
    """WIN-12: of each request's (length, path) rows the shortest, then the next that shares under 0.7 with all kept, up to most, as alt."""
    out = None
    for alt in range(most):
        best = landed(left.groupBy("request").agg(F.min(F.struct("length", "path")).alias("m")).select("request", "m.length", "m.path"))
        part = best.withColumn("alt", F.lit(alt))
        out = part if out is None else out.unionByName(part)
        both = left.join(best.select("request", F.col("path").alias("b")), "request")
        n = F.size(F.filter("path", lambda e: F.array_contains("b", e))) / F.greatest(F.size("path"), F.size("b"))
        left = landed(both.filter(n < SHARED).drop("b"))
    return out


def few_diverse(found: DataFrame, most: int = MOST) -> DataFrame:
    """The same for (length, steps, source) rows of which a request has a bounded number, as the routes through one place (4 by 4): gone through in one group."""
    ordered = found.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("length", "steps", "source"))).alias("all"))
    return picked(ordered, most)


def picked(ordered: DataFrame, most: int, limit: Column | None = None) -> DataFrame:
    """(request, alt, ...) of the rows of the array all that are taken in turn: those that share under 0.7 with each one taken.  limit is the largest dup that a row may have after the first."""
    item = ordered.schema["all"].dataType.simpleString()

    def take(chosen: Column, x: Column) -> Column:
        good = F.forall(chosen, lambda y: share(y["steps"], x["steps"]) < SHARED)
        if limit is not None:
            good = good & ((F.size(chosen) == 0) | (x["dup"] <= limit))
        return F.when((F.size(chosen) < most) & good, F.concat(chosen, F.array(x))).otherwise(chosen)

    chosen = ordered.select("request", F.aggregate("all", F.array().cast(item), take).alias("chosen"))
    return chosen.select("request", F.posexplode("chosen").alias("alt", "x")).select("request", "alt", "x.*")


def markers(route_points: DataFrame, every: float = 120.0) -> DataFrame:
    """WIN-8: (request, at, lng, lat, bearing): a place each so many metres along (request, step, ax, ay, bx, by), or the middle of a shorter route."""
    s = route_points.withColumn("len", haversine("ax", "ay", "bx", "by"))
    along = Window.partitionBy("request").orderBy("step")
    s = s.withColumn("start", F.sum("len").over(along) - F.col("len")).withColumn("total", F.sum("len").over(Window.partitionBy("request")))
    low, high = F.ceil(F.greatest(F.col("start"), F.lit(1e-9)) / every), F.ceil((F.col("start") + F.col("len")) / every) - 1
    many = F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda i: i * every)).otherwise(F.array().cast("array<double>"))
    mid = F.when((F.col("start") <= F.col("total") / 2) & (F.col("total") / 2 < F.col("start") + F.col("len")), F.array(F.col("total") / 2)).otherwise(F.array().cast("array<double>"))
    each = s.withColumn("at", F.explode(F.when(F.col("total") > every, many).otherwise(mid)))
    share = (F.col("at") - F.col("start")) / F.col("len")
    return each.select("request", "at", between("ax", "bx", share).alias("lng"), between("ay", "by", share).alias("lat"), bearing("ax", "ay", "bx", "by").alias("bearing"))


def outcomes(requests: DataFrame, sources: DataFrame, targets: DataFrame, routes: DataFrame, any_trails: bool = True) -> DataFrame:
    """GRF-14: (request, status), the first that holds of no-trails, no-start, no-end, no-route, ok."""
    has = lambda df, c: df.select("request").distinct().withColumn(c, F.lit(True))
    j = requests.join(has(sources, "s"), "request", "left").join(has(targets, "t"), "request", "left").join(has(routes, "r"), "request", "left")
    status = F.when(F.lit(not any_trails), "no-trails").when(F.col("s").isNull(), "no-start").when(F.col("t").isNull(), "no-end").when(F.col("r").isNull(), "no-route").otherwise("ok")
    return j.select("request", status.alias("status"))
