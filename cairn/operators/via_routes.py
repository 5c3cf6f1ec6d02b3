"""Routes through several places in any order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.session import landed
from cairn.operators.near_routes import Dealt, answered, carried_on, dealt
from cairn.operators.routes import MOST, PENALTY, STEPS, contracted, ends_of, further, picked, steps_in, unpacked

#: Places of a request at most, and up to which all orderings are tried; with more, only the shortest by the distances between places.
MOST_VIAS, ALL_ORDERINGS = 4, 3
#: Ways through one ordering, its plain route counted; and the share of repeated edges that a further route may have.
BRANCHES, REPEATED = 48, 0.10


def orderings(requests: DataFrame) -> DataFrame:
    """(own, request, rank, places): each order of the places of a request (request, source, vias, target), from source to target; own numbers them.

    Orders in which a place follows itself have no route and are left out.
    """
    if requests.filter(F.size("vias") > MOST_VIAS).limit(1).count():
        raise ValueError(f"more than {MOST_VIAS} places in a request")
    orders = [F.array(*(F.array(*map(F.lit, p)) for p in permutations(range(n)))) for n in range(1, MOST_VIAS + 1)]
    each = F.when(F.size("vias") == 1, orders[0])
    for n in range(2, MOST_VIAS + 1):
        each = each.when(F.size("vias") == n, orders[n - 1])
    placed = requests.select("request", "source", "vias", "target", F.posexplode(each).alias("rank", "order"))
    placed = placed.select("request", "rank", F.concat(F.array("source"), F.transform("order", lambda i: F.get("vias", i)), F.array("target")).alias("places"))
    stays = F.forall(F.sequence(F.lit(1), F.size("places") - 1), lambda i: F.get("places", i - 1) != F.get("places", i))
    return placed.filter(stays).select(F.xxhash64("request", "rank").alias("own"), "request", "rank", "places")


def legs_of(placed: DataFrame) -> DataFrame:
    """A row for each leg, from source to target."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("places") - 1), lambda i: F.struct(F.get("places", i - 1).alias("source"), F.get("places", i).alias("target")))
    return placed.select("*", F.posexplode(pairs).alias("leg", "ends")).select("*", "ends.*").drop("ends")


def plain_routes(placed: DataFrame, net: DataFrame, parts: Dealt | None = None) -> DataFrame:
    """(own, request, rank, places, source, length, steps): the shortest paths of all legs one after another; of orderings with more than ALL_ORDERINGS places, the shortest of each request.

    Each pair of places is searched once, however many orderings and requests ask for it.
    """
    parts = parts or dealt(net)
    legs = landed(legs_of(placed).withColumn("pair", F.xxhash64("source", "target")))
    found = answered(legs.select(F.col("pair").alias("request"), "source", "target").distinct(), net, parts, 1).select(F.col("request").alias("pair"), "steps", "length")
    parts = F.sort_array(F.collect_list(F.struct("leg", "steps", "length")))
    whole = legs.join(found, "pair").groupBy("own", "request", "rank", "places").agg(parts.alias("parts")).filter(F.size("parts") == F.size("places") - 1)
    total = F.aggregate("parts.length", F.lit(0.0), lambda x, y: x + y)
    whole = whole.select("own", "request", "rank", "places", F.get("places", F.lit(0)).alias("source"), total.alias("length"), F.flatten("parts.steps").alias("steps"))
    many = F.size("places") > ALL_ORDERINGS + 2
    nth = F.row_number().over(Window.partitionBy("request").orderBy(F.round("length", 6), "rank"))
    return landed(whole.withColumn("nth", nth).filter(~many | (F.col("nth") == 1)).drop("nth"))


def all_branches(base: DataFrame, net: DataFrame, parts: Dealt) -> DataFrame:
    """The ways through each ordering with base's columns: leg by leg in groups where components are small, and by branches() for the others."""
    columns = base.columns
    own = base.join(parts.nodes.withColumnRenamed("node", "source"), "source")
    now = own.withColumns({"branch": F.array().cast("array<int>"), "steps": F.array().cast(STEPS), "length": F.lit(0.0)})
    for leg in range(1, base.agg(F.max(F.size("places"))).first()[0] or 0):
        now = carried_on(now, parts, leg, BRANCHES - 1)
    out = now.select(columns)
    if not parts.others:
        return out
    rest = landed(base.join(parts.nodes.withColumnRenamed("node", "source"), "source", "left_anti").select(columns))
    return out.unionByName(branches(rest, net).join(rest.drop("steps", "length"), "own").select(columns))


def branches(base: DataFrame, net: DataFrame) -> DataFrame:
    """(own, steps, length): the ways through each ordering, on each leg up to four that avoid the edges of the legs before; the first ones in order of branch.

    Places of a found ordering are connected, so each beginning of a way leads to one at least:
    no more beginnings are carried on than ways are asked for.
    """
    now = base.select("own", "places", F.array().cast("array<int>").alias("branch"), F.array().cast(STEPS).alias("steps"), F.lit(0.0).alias("length"))
    most = base.agg(F.max(F.size("places"))).first()[0] or 0
    done = now.limit(0)
    for leg in range(1, most):
        done = done.unionAll(now.filter(F.size("places") <= leg))
        going = landed(now.filter(F.size("places") > leg).withColumn("id", F.xxhash64("own", "branch")))
        # Beginnings that have used the same edges and go on alike are searched as one.
        used = F.array_sort(F.array_distinct("steps.edge"))
        going = landed(going.withColumns({"from": F.get("places", F.lit(leg - 1)), "to": F.get("places", F.lit(leg)), "used": used}).withColumn("like", F.xxhash64("from", "to", "used")))
        asked = landed(going.groupBy(F.col("like").alias("request")).agg(F.first("from").alias("source"), F.first("to").alias("target"), F.first("used").alias("used")))
        avoid = None if leg == 1 else asked.select("request", F.explode("used").alias("edge")).withColumn("factor", F.lit(PENALTY))
        found = further(asked.select("request", "source", "target"), net, MOST, avoid).select(F.col("request").alias("like"), "alt", F.col("steps").alias("more"), F.col("length").alias("far"))
        each = going.join(found, "like").select("own", "places", F.concat("branch", F.array("alt")).alias("branch"), F.concat("steps", "more").alias("steps"), (F.col("length") + F.col("far")).alias("length"))
        nth = F.row_number().over(Window.partitionBy("own").orderBy("branch"))
        now = landed(each.withColumn("nth", nth).filter(F.col("nth") < BRANCHES).drop("nth"))
    return done.unionAll(now).select("own", "steps", "length")


def repeated(steps: Column) -> Column:
    """Share of the edges of a route that it has been over before."""
    once = F.aggregate(F.array_distinct(F.transform(steps, lambda x: F.struct(x["edge"].alias("edge"), x["n"].alias("n")))), F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"])
    return (steps_in(steps) - once) / steps_in(steps)


def inversions(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(own, inversions): share of neighbouring vias that lie the other way along the line from source to target."""
    at = base.select("own", F.posexplode("places").alias("i", "node")).join(nodes.select("node", "lng", "lat"), "node")
    line = at.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("i", "lng", "lat"))).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    dx, dy = last["lng"] - first["lng"], last["lat"] - first["lat"]
    along = F.transform(F.slice("p", F.lit(2), F.size("p") - 2), lambda x: (x["lng"] - first["lng"]) * dx + (x["lat"] - first["lat"]) * dy)
    pairs = F.greatest(F.size("a") - 1, F.lit(0))
    down = F.size(F.filter(F.zip_with(F.slice("a", F.lit(1), pairs), F.slice("a", F.lit(2), pairs), lambda x, y: x > y), lambda x: x))
    return line.withColumn("a", along).select("own", (down / F.greatest(pairs, F.lit(1))).alias("inversions"))


def routes_through(requests: DataFrame, net: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """through_all over a network; paths as steps."""
    parts = dealt(net, nodes if "component" in nodes.columns else None)
    base = plain_routes(orderings(requests), net, parts)
    base = landed(base.join(inversions(base, nodes), "own").drop("rank"))
    found = base.unionByName(all_branches(base, net, parts))
    score = F.struct(F.round(repeated(F.col("steps")) * 100).alias("d"), F.round("length").alias("m"), F.col("inversions").alias("i"), F.round("length", 6).alias("l"))
    row = F.struct(score.alias("score"), "steps", "length", repeated(F.col("steps")).alias("dup"), "source")
    ordered = found.groupBy("request").agg(F.array_sort(F.collect_set(row)).alias("all"))
    return picked(ordered, most, F.lit(REPEATED)).drop("score")


def through_all(requests: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """GRF-11: up to four routes (request, alt, length, dup, path, stops) of each request (request, source, vias, target).

    Of at most 48 ways through each ordering come first those with the least share of repeated edges
    (in hundredths), then the shortest (in metres), then those that go least back and forth.  After the
    first, a route repeats a tenth of its edges at most and shares under 0.7 with all before it.
    Requests without vias have no route, nor have orderings in which a place follows itself; more
    than four vias are an error.  A request has at most 6 * 48 ways, the group that is picked from.
    """
    net, chains = contracted(edges, ends_of(requests, "source", "target").unionAll(requests.select(F.explode("vias").alias("node"))))
    return unpacked(routes_through(requests, net, nodes, most), chains)


def choices(requests: DataFrame) -> DataFrame:
    """JOIN-24: (request, source, vias, target, order): one candidate for each via, all ways to choose; order has their places in the candidates' lists.

    requests has candidates, an array of arrays of nodes, four by four at most.
    """
    if requests.filter((F.size("candidates") > MOST_VIAS) | F.exists("candidates", lambda c: F.size(c) > MOST)).limit(1).count():
        raise ValueError(f"more than {MOST_VIAS} places or {MOST} candidates for one in a request")
    each = requests.select("request", "source", "candidates", "target", F.array().cast("array<bigint>").alias("vias"), F.array().cast("array<int>").alias("order"))
    for k in range(MOST_VIAS):
        listed = F.when(F.size("candidates") > k, F.get("candidates", F.lit(k))).otherwise(F.array(F.lit(None).cast("long")))
        more = each.select("*", F.posexplode(listed).alias("n", "via"))
        grown = F.col("via").isNotNull()
        each = more.select("request", "source", "candidates", "target", F.when(grown, F.concat("vias", F.array("via"))).otherwise(F.col("vias")).alias("vias"), F.when(grown, F.concat("order", F.array("n"))).otherwise(F.col("order")).alias("order"))
    return each.drop("candidates")


def best_of(first: DataFrame) -> DataFrame:
    """(request, choice): of the rows (request, choice, order, dup, length), taken in order, one that repeats less by over a hundredth is better, then within a hundredth one that is shorter.

    The rule is no order, so the rows of a request (256 at most) are gone through one by one.
    """
    rows = first.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("order", "dup", "length", "choice"))).alias("all"))

    def better(best: Column, x: Column) -> Column:
        apart = F.abs(x["dup"] - best["dup"]) > 0.01
        return F.when(F.when(apart, x["dup"] < best["dup"]).otherwise(x["length"] < best["length"]), x).otherwise(best)

    best = F.aggregate(F.slice("all", 2, 256), F.element_at("all", 1), better)
    return rows.select("request", best["choice"].alias("choice"))


def through_best(requests: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """GRF-12: the routes (request, vias, alt, length, dup, path, stops) of the best choice of one candidate for each via.

    requests is (request, source, candidates, target); choices compare by the first route of each, as best_of says.
    """
    each = landed(choices(requests).withColumn("choice", F.xxhash64("request", "order")))
    net, chains = contracted(edges, ends_of(requests, "source", "target").unionAll(each.select(F.explode("vias").alias("node"))))
    found = landed(routes_through(each.select(F.col("choice").alias("request"), "source", "vias", "target"), net, nodes, most).withColumnRenamed("request", "choice"))
    best = best_of(found.filter("alt = 0").select("choice", "dup", "length").join(each.select("choice", "request", "order"), "choice"))
    own = best.join(each.select("choice", "vias"), "choice")
    return unpacked(found.join(own, "choice").drop("choice"), chains)
