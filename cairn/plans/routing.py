"""The trail network and routes over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import haversine
from cairn.functions.session import kept, landed
from cairn.operators import graph, routes, via_routes
from cairn.operators.lines import vertex_pairs
from cairn.plans.basics import hav
from cairn.plans.registry import VIEWS, query, table, view

VIEWS["v_shifted_vertices"] = "SELECT osm_id, pos, CASE WHEN CAST(floor(osm_id / 200) AS BIGINT) % 2 = 1 THEN lng + 0.0003 ELSE lng END AS lng, lat FROM v_trail_vertices"

#: A mesh of three by three crossings, with a vertex between two of them, for each supplier; some of the six lines lack.
MESH_X, MESH_Y = "CASE WHEN line < 3 THEN pos ELSE 2 * (line - 3) END", "CASE WHEN line < 3 THEN 2 * line ELSE pos END"
AT = "(900000 + (s_suppkey % 200) * 5000 + ({x}) * 150 + (s_suppkey * 31 + ({x}) * 17 + ({y}) * 29) % 40 + {off}) / 100000 AS lng, (4600000 + CAST(floor(s_suppkey / 200) AS BIGINT) * 5000 + ({y}) * 150 + (s_suppkey * 13 + ({x}) * 23 + ({y}) * 7) % 40 + {off}) / 100000 AS lat"
FIVE = "(SELECT 0 AS {0} UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4{1})"
VIEWS["v_mesh_vertices"] = f"""SELECT 6000000 + s_suppkey * 10 + line AS osm_id, pos, {AT.format(x=MESH_X, y=MESH_Y, off=0)}
FROM supplier CROSS JOIN {FIVE.format('line', ' UNION ALL SELECT 5')} x CROSS JOIN {FIVE.format('pos', '')} y WHERE (s_suppkey + line) % 7 <> 0"""
#: Places near crossings: 0 to begin at, 1 to end at, 2 and 3 to pass.
VIEWS["v_mesh_places"] = f"""SELECT s_suppkey AS request, place, {AT.format(x='CASE WHEN place = 1 OR place = 2 THEN 4 ELSE 0 END', y='CASE WHEN place = 1 OR place = 3 THEN 4 ELSE 0 END', off=20)}
FROM supplier CROSS JOIN (SELECT 0 AS place UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p"""

#: Trips over the meshes, of six kinds in turn: as it should be (0 and 5), begun 400 m off (1), begun or ended 1500 m off (2 and 3), and ended in the next mesh (4).
VIEWS["v_mesh_trips"] = """SELECT a.request AS request_id, a.lng - CASE a.request % 6 WHEN 1 THEN 0.0052 WHEN 2 THEN 0.02 ELSE 0 END AS from_lng, a.lat AS from_lat,
  CASE WHEN b.request % 6 = 4 AND c.lng IS NOT NULL THEN c.lng WHEN b.request % 6 = 3 THEN b.lng + 0.02 ELSE b.lng END AS to_lng, CASE WHEN b.request % 6 = 4 AND c.lng IS NOT NULL THEN c.lat ELSE b.lat END AS to_lat
FROM v_mesh_places a JOIN v_mesh_places b ON b.request = a.request AND a.place = 0 AND b.place = 1 LEFT JOIN v_mesh_places c ON c.request = a.request + 1 AND c.place = 1"""

KEY = "CAST(floor({0} * 1e5 + 0.5) AS BIGINT) * 4294967296 + CAST(floor({1} * 1e5 + 0.5) AS BIGINT) + 2147483648"


def network_sql(vertices: str) -> str:
    return f"""sv AS (SELECT osm_id, pos, lng AS ax, lat AS ay, lead(lng) OVER (PARTITION BY osm_id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY osm_id ORDER BY pos) AS by_ FROM {vertices}),
raw AS (SELECT osm_id AS feature, pos, {KEY.format('ax', 'ay')} AS a, {KEY.format('bx', 'by_')} AS b, {hav('ax', 'ay', 'bx', 'by_')} AS weight FROM sv WHERE bx IS NOT NULL),
ed AS (SELECT a, b, min(weight) AS weight FROM (SELECT a, b, weight FROM raw UNION ALL SELECT b, a, weight FROM raw) WHERE a <> b GROUP BY a, b),
nd AS (SELECT {KEY.format('lng', 'lat')} AS node, min(lng) AS lng, min(lat) AS lat FROM {vertices} GROUP BY 1),
cc AS (SELECT node, node AS root FROM nd UNION SELECT ed.b, cc.root FROM cc JOIN ed ON ed.a = cc.node),
cp AS (SELECT node, min(root) AS component FROM cc GROUP BY node),
sz AS (SELECT component, count(*) AS size FROM cp GROUP BY component),
rq AS (SELECT component AS request, min(node) AS source, max(node) AS target FROM cp GROUP BY component HAVING count(*) > 3)"""


NETWORK = network_sql("v_trail_vertices")


def network(spark, d, vertices: str = "v_trail_vertices", edges_of=graph.least_edges) -> tuple[DataFrame, DataFrame]:
    """Nodes with components, and edges."""
    v = view(spark, d, vertices)
    nodes = kept(graph.nodes_of(v))
    edges = kept(edges_of(v, graph.merged(nodes)))
    return kept(graph.component_sizes(nodes, edges)), edges


def requests(nodes: DataFrame) -> DataFrame:
    """One request from the first to the last node of each component of over three nodes."""
    ends = nodes.groupBy(F.col("component").alias("request")).agg(F.min("node").alias("source"), F.max("node").alias("target"), F.count("*").alias("n"))
    return kept(ends.filter("n > 3").drop("n"))


@query("GRF-1", f"WITH RECURSIVE {NETWORK} SELECT feature, pos, a, b, round(weight, 5) AS weight FROM raw WHERE a <> b")
def grf_1(spark, d):
    return network(spark, d, edges_of=graph.edges_of)[1].withColumn("weight", F.round("weight", 5))


@query("GRF-2", f"WITH RECURSIVE {NETWORK} SELECT node, node AS leader FROM nd")
def grf_2(spark, d):
    return graph.merged(graph.nodes_of(view(spark, d, "v_trail_vertices")))


@query("JOIN-10")
def join_10(spark, d):
    """Pairs among vertices of which every third is moved by 1e-5 degrees."""
    v = view(spark, d, "v_trail_vertices").withColumn("lng", F.col("lng") + F.when(F.col("osm_id") % 3 == 0, 1e-5).otherwise(0.0))
    return graph.close_nodes(graph.nodes_of(v))


@query("GRF-3", f"WITH RECURSIVE {NETWORK} SELECT node, component, size FROM cp JOIN sz USING (component)")
def grf_3(spark, d):
    return network(spark, d)[0].select("node", "component", "size")


BRIDGES = f"""WITH RECURSIVE {network_sql('v_shifted_vertices')}, big AS (SELECT cp.node, component, lng, lat, CAST(floor(lng / 0.0005) AS BIGINT) AS cx, CAST(floor(lat / 0.0005) AS BIGINT) AS cy FROM cp JOIN sz USING (component) JOIN nd ON nd.node = cp.node WHERE size >= 3),
br AS (SELECT x.component AS ca, y.component AS cb, {hav('x.lng', 'x.lat', 'y.lng', 'y.lat')} AS weight FROM big x JOIN big y ON x.component < y.component AND abs(x.cx - y.cx) <= 1 AND abs(x.cy - y.cy) <= 1)
SELECT count(*) AS n, round(sum(w), 3) AS metres FROM (SELECT ca, cb, min(weight) AS w FROM br GROUP BY ca, cb) WHERE w <= 50"""


@query("GRF-4", BRIDGES)
def grf_4(spark, d):
    nodes, _ = network(spark, d, "v_shifted_vertices")
    return graph.bridges(nodes).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("metres"))


@query("JOIN-11", BRIDGES.replace("count(*) AS n, round(sum(w), 3) AS metres", "ca, cb, round(w, 5) AS weight"))
def join_11(spark, d):
    nodes, _ = network(spark, d, "v_shifted_vertices")
    own = nodes.select("node", "component")
    b = graph.bridges(nodes).join(own.toDF("a", "ca"), "a").join(own.toDF("b", "cb"), "b")
    return b.select("ca", "cb", F.round("weight", 5).alias("weight"))


def snapped(spark, d, nodes, k: int = graph.SNAP_K, trips: str = "v_route_requests"):
    r = view(spark, d, trips)
    one = lambda a, b: graph.snap(r.select(F.col("request_id").alias("point"), F.col(a).cast("double").alias("lng"), F.col(b).cast("double").alias("lat")), nodes, 500.0, k)
    return one("from_lng", "from_lat"), one("to_lng", "to_lat")


@query("GRF-5", f"WITH n AS (SELECT DISTINCT {KEY.format('lng', 'lat')} AS node, lng, lat FROM v_trail_vertices), s AS (SELECT request_id AS point, node, {hav('from_lng', 'from_lat', 'lng', 'lat')} AS dist FROM v_route_requests JOIN n ON abs(from_lng - lng) < 0.02 AND abs(from_lat - lat) < 0.02) SELECT point, node, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY dist, node) AS r FROM s WHERE dist <= 500) WHERE r <= 6")
def grf_5(spark, d):
    nodes = graph.nodes_of(view(spark, d, "v_trail_vertices"))
    return snapped(spark, d, nodes)[0].select("point", "node", F.round("dist", 5).alias("dist"))


@query("AGG-8", f"WITH RECURSIVE {NETWORK} SELECT max(size) AS largest, greatest(10, CAST(floor(max(size) * 0.05) AS BIGINT)) AS least FROM sz")
def agg_8(spark, d):
    return graph.least_component(network(spark, d)[0])


PATHS = f"""WITH RECURSIVE {NETWORK},
pt AS (SELECT request, source AS node, 0.0::DOUBLE AS cost, [source] AS seen FROM rq UNION ALL SELECT pt.request, ed.b, pt.cost + ed.weight, list_append(pt.seen, ed.b) FROM pt JOIN ed ON ed.a = pt.node WHERE NOT list_contains(pt.seen, ed.b)),
sp AS (SELECT request, min(cost) AS length FROM pt JOIN rq USING (request) WHERE node = target GROUP BY request)"""


@query("GRF-6", f"{PATHS} SELECT request, round(length, 5) AS length FROM sp")
def grf_6(spark, d):
    nodes, edges = network(spark, d)
    return routes.shortest(requests(nodes), kept(graph.simple_edges(edges))).select("request", F.round("length", 5).alias("length"))


@query("GRF-15", f"{PATHS} SELECT request, round(coalesce(length, 'infinity'::DOUBLE), 5) AS length FROM rq LEFT JOIN sp USING (request)")
def grf_15(spark, d):
    nodes, edges = network(spark, d)
    asked = requests(nodes)
    found = routes.shortest(asked, kept(graph.simple_edges(edges)))
    return asked.join(found, "request", "left").select("request", F.round(F.coalesce("length", F.lit(float("inf"))), 5).alias("length"))


@query("GRF-7")
def grf_7(spark, d):
    nodes, edges = network(spark, d)
    ends = requests(nodes)
    near = lambda c: graph.snap(ends.join(nodes, ends[c] == nodes["node"]).select(F.col("request").alias("point"), "lng", "lat"), nodes, graph.SNAP_M, graph.SNAP_K).select(F.col("point").alias("request"), "node")
    return routes.best_snapped(near("source"), near("target"), kept(graph.simple_edges(edges))).select("request", "source", "target", F.round("length", 5).alias("length"))


def trips(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trips over the meshes: where they may start and end within 500 m, and their routes: those at 300 m, and for the others at 500 m among components of some size."""
    nodes, edges = network(spark, d, "v_mesh_vertices")
    one = kept(graph.simple_edges(edges))
    s, t = (landed(x.select(F.col("point").alias("request"), "node", "dist")) for x in snapped(spark, d, nodes, trips="v_mesh_trips"))
    near = f"dist <= {graph.SNAP_M}"
    first = landed(routes.best_snapped(s.filter(near), t.filter(near), one).withColumn("retried", F.lit(False)))
    large = nodes.join(F.broadcast(graph.least_component(nodes)), F.col("size") >= F.col("least")).select("node")
    again = lambda x: landed(x.join(first, "request", "left_anti").join(large, "node", "left_semi"))
    return s, t, first.unionByName(routes.best_snapped(again(s), again(t), one).withColumn("retried", F.lit(True)))


TRIPS = f"""WITH RECURSIVE {network_sql('v_mesh_vertices')},
near AS (SELECT request_id, side, node, row_number() OVER (PARTITION BY request_id, side ORDER BY dist, node) AS r, dist FROM (SELECT request_id, side, node, {hav('x', 'y', 'lng', 'lat')} AS dist
  FROM (SELECT request_id, 's' AS side, from_lng AS x, from_lat AS y FROM v_mesh_trips UNION ALL SELECT request_id, 't', to_lng, to_lat FROM v_mesh_trips) p JOIN nd ON abs(x - lng) < 0.01 AND abs(y - lat) < 0.01) q WHERE dist <= 500),
hits AS (SELECT request_id, side, near.node, component, dist FROM near JOIN cp ON cp.node = near.node WHERE r <= 6),
linked AS (SELECT s.request_id, bool_or(s.dist <= 300 AND t.dist <= 300) AS early FROM hits s JOIN hits t ON s.request_id = t.request_id AND s.side = 's' AND t.side = 't' AND s.component = t.component AND s.node <> t.node GROUP BY s.request_id)"""


@query("GRF-8", f"{TRIPS} SELECT request_id AS request, NOT early AS retried FROM linked")
def grf_8(spark, d):
    """Which trips have a route, and which of them only when asked again."""
    return trips(spark, d)[2].select("request", "retried")


@query("GRF-9")
def grf_9(spark, d):
    nodes, edges = network(spark, d)
    return routes.alternatives(requests(nodes), kept(graph.simple_edges(edges))).select("request", "alt", F.round("length", 5).alias("length"))


@query("GRF-10")
def grf_10(spark, d):
    nodes, edges = network(spark, d)
    mid = nodes.groupBy(F.col("component").alias("request")).agg(F.element_at(F.array_sort(F.collect_list("node")), 3).alias("via"))
    asked = requests(nodes).withColumn("id", F.row_number().over(Window.partitionBy(F.col("request") % 97).orderBy("request")) * 97 + F.col("request") % 97).join(mid, "request").filter("via <> source and via <> target")
    return routes.through(asked.select(F.col("id").cast("long").alias("request"), "source", "via", "target"), kept(graph.simple_edges(edges))).select("request", "alt", F.round("length", 5).alias("length"))


def meshes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes and simple edges of the meshes; components are left to those who search them, on fewer edges."""
    v = view(spark, d, "v_mesh_vertices")
    nodes = kept(graph.nodes_of(v))
    return nodes, kept(graph.simple_edges(graph.least_edges(v, graph.merged(nodes))))


def mesh_requests(spark, d, nodes: DataFrame, k: int) -> DataFrame:
    """(request, source, candidates, target): the node nearest to each end, and the k nearest to each place to pass."""
    places = view(spark, d, "v_mesh_places").select("request", "place", F.xxhash64("request", "place").alias("point"), F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat"))
    near = graph.snap(places, nodes, graph.SNAP_M, k).groupBy("request", "place").agg(F.array_sort(F.collect_list(F.struct("rank", "node")))["node"].alias("nodes"))
    end = lambda n: F.max(F.when(F.col("place") == n, F.get("nodes", F.lit(0))))
    vias = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "nodes")))), lambda x: x["nodes"])
    return near.groupBy("request").agg(end(0).alias("source"), end(1).alias("target"), vias.alias("candidates")).filter("source is not null and target is not null")


@query("GRF-11")
def grf_11(spark, d):
    """Routes through two places of each mesh, in any order."""
    nodes, edges = meshes(spark, d)
    asked = mesh_requests(spark, d, nodes, 1).withColumn("vias", F.transform("candidates", lambda c: F.get(c, F.lit(0)))).drop("candidates")
    found = via_routes.through_all(landed(asked), edges, nodes)
    return found.select("request", "alt", F.round("length", 3).alias("length"), F.round("dup", 9).alias("dup"), F.size("path").alias("steps"))


@query("GRF-12")
def grf_12(spark, d):
    """The same with the two nearest nodes of each place to choose from."""
    nodes, edges = meshes(spark, d)
    found = via_routes.through_best(landed(mesh_requests(spark, d, nodes, 2)), edges, nodes)
    return found.select("request", "alt", F.element_at("vias", 1).alias("via_1"), F.element_at("vias", 2).alias("via_2"), F.round("length", 3).alias("length"), F.round("dup", 9).alias("dup"))


@query("GRF-13")
def grf_13(spark, d):
    nodes, edges = network(spark, d)
    return routes.round_trip(requests(nodes), kept(graph.simple_edges(edges))).select("request", F.round("out_length", 5).alias("out_length"), F.round("back_length", 5).alias("back_length"), "only_one_path")


@query("GRF-14", f"""{TRIPS} SELECT v.request_id AS request, CASE WHEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.request_id = v.request_id AND side = 's') THEN 'no-start' WHEN NOT EXISTS (SELECT 1 FROM hits h WHERE h.request_id = v.request_id AND side = 't') THEN 'no-end'
WHEN l.request_id IS NULL THEN 'no-route' ELSE 'ok' END AS status FROM v_mesh_trips v LEFT JOIN linked l ON l.request_id = v.request_id""")
def grf_14(spark, d):
    s, t, found = trips(spark, d)
    return routes.outcomes(view(spark, d, "v_mesh_trips").select(F.col("request_id").alias("request")), s, t, found)


@query("GRF-16", "SELECT osm_id, pos, CASE WHEN osm_id % 2 = 1 THEN bx ELSE ax END AS x0, CASE WHEN osm_id % 2 = 1 THEN ax ELSE bx END AS x1 FROM v_segments")
def grf_16(spark, d):
    """Segments as features, turned round where a route takes them backwards (here on odd ids)."""
    s = vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id")
    ends = F.array("ax", "bx")
    line = F.when(F.col("osm_id") % 2 == 1, F.reverse(ends)).otherwise(ends)
    return s.select("osm_id", "pos", line[0].alias("x0"), line[1].alias("x1"))


@query("WIN-8", f"""WITH s AS (SELECT osm_id AS request, pos, ax, ay, bx, by_, {hav('ax', 'ay', 'bx', 'by_')} AS len FROM v_segments),
c AS (SELECT *, sum(len) OVER (PARTITION BY request ORDER BY pos) - len AS start, sum(len) OVER (PARTITION BY request) AS total FROM s),
m AS (SELECT *, CAST(unnest(range(CAST(ceil(greatest(start, 1e-9) / 120) AS BIGINT), CAST(ceil((start + len) / 120) AS BIGINT))) * 120 AS DOUBLE) AS place FROM c WHERE total > 120 UNION ALL SELECT *, total / 2 FROM c WHERE total <= 120 AND start <= total / 2 AND total / 2 < start + len)
SELECT request, round(place, 4) AS place, round(ax + (bx - ax) * (place - start) / len, 7) AS lng FROM m""")
def win_8(spark, d):
    s = vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").select(F.col("osm_id").alias("request"), F.col("pos").alias("step"), "ax", "ay", "bx", "by")
    return routes.markers(s).select("request", F.round("at", 4).alias("place"), F.round("lng", 7).alias("lng"))


EVENT_PATHS = "ep AS (SELECT user_id AS request, list(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) ORDER BY event_id) AS path FROM events GROUP BY user_id)"


def event_paths(spark, d):
    """A path for each user: the numbers of their events in order."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("request")).agg(F.array_sort(F.collect_list(F.struct("event_id", k.alias("k")))).alias("s"))
    return e.select("request", F.transform("s", lambda x: x["k"]).alias("path"))


@query("AGG-10", f"WITH {EVENT_PATHS} SELECT a.request, round(len(list_filter(b.path, lambda x: list_contains(a.path, x))) / greatest(len(a.path), len(b.path)), 9) AS shared FROM ep a JOIN ep b ON b.request = a.request + 1")
def agg_10(spark, d):
    p = event_paths(spark, d)
    return routes.shared(p, p.withColumn("request", F.col("request") - 1)).select("request", F.round("shared", 9).alias("shared"))


@query("AGG-11", f"WITH {EVENT_PATHS} SELECT request, round(1 - len(list_distinct(path)) / len(path), 9) AS repeated FROM ep")
def agg_11(spark, d):
    return event_paths(spark, d).select("request", F.round(1 - F.size(F.array_distinct("path")) / F.size("path"), 9).alias("repeated"))


@query("AGG-12", "WITH p AS (SELECT user_id, event_id, value AS along, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) SELECT user_id, round(avg(CASE WHEN next < along THEN 1.0 ELSE 0.0 END), 9) AS inversions FROM p WHERE next IS NOT NULL GROUP BY user_id")
def agg_12(spark, d):
    nxt = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    p = table(spark, d, "events").select("user_id", F.col("value").alias("along"), nxt.alias("next")).filter("next is not null")
    return p.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("next") < F.col("along"), 1.0).otherwise(0.0)), 9).alias("inversions"))


@query("JOIN-23", f"SELECT osm_id, pos, round({hav('ax', 'ay', 'bx', 'by_')} * CASE WHEN osm_id % 5 = 0 THEN 8.0 ELSE 1.0 END, 5) AS cost FROM v_segments")
def join_23(spark, d):
    s = vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").withColumn("weight", haversine("ax", "ay", "bx", "by"))
    penalty = view(spark, d, "v_trails_attr").filter("osm_id % 5 = 0").select("osm_id", F.lit(routes.PENALTY).alias("factor"))
    return s.join(penalty, "osm_id", "left").select("osm_id", "pos", F.round(F.col("weight") * F.coalesce("factor", F.lit(1.0)), 5).alias("cost"))


VIA = "vc AS (SELECT s_nationkey AS request, s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS c FROM supplier)"


@query("JOIN-24", f"WITH {VIA} SELECT a.request, a.node AS v1, b.node AS v2 FROM vc a JOIN vc b ON a.request = b.request WHERE a.c <= 4 AND b.c <= 4")
def join_24(spark, d):
    """Two places of each nation, each with its first four suppliers as candidates."""
    held = four_suppliers(spark, d).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("c", "node")))["node"].alias("own"))
    asked = held.select("request", F.lit(-1).cast("long").alias("source"), F.array("own", "own").alias("candidates"), F.lit(-2).cast("long").alias("target"))
    return via_routes.choices(asked).select("request", F.col("vias")[0].alias("v1"), F.col("vias")[1].alias("v2"))


def four_suppliers(spark, d) -> DataFrame:
    c = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long")
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("request"), F.col("s_suppkey").cast("long").alias("node"), c.alias("c")).filter("c <= 4")


@query("JOIN-25", f"WITH {VIA} SELECT a.request, a.node AS leg1, b.node AS leg2, a.c + b.c AS weight FROM vc a JOIN vc b ON a.request = b.request WHERE a.c <= 4 AND b.c <= 4")
def join_25(spark, d):
    """Routes of one edge to each of a nation's first four suppliers, and on to each of them."""
    step = F.array(F.struct(F.col("node").alias("edge"), F.lit(1).cast("long").alias("n"), "node"))
    alts = four_suppliers(spark, d).select(F.col("request").alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("leg"), F.lit(-1).cast("long").alias("source"), F.col("c").cast("double").alias("length"), step.alias("steps"))
    return routes.leg_pairs(alts).select("request", F.col("steps")[0]["edge"].alias("leg1"), F.col("steps")[1]["edge"].alias("leg2"), F.col("length").cast("long").alias("weight"))


@query("WIN-12")
def win_12(spark, d):
    """Up to four of the event paths of users alike in the last digit, shortest first, that differ enough."""
    p = event_paths(spark, d).select((F.col("request") % 10).alias("request"), F.size("path").cast("double").alias("length"), "path")
    return routes.diverse(kept(p), 4).select("request", "alt", "length")


@query("SRT-6", "SELECT user_id AS request, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS rank FROM events")
def srt_6(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("request"), "event_id", r.alias("rank"))


@query("SRT-7", f"WITH {EVENT_PATHS} SELECT request, CAST(row_number() OVER (ORDER BY floor((1 - len(list_distinct(path)) / len(path)) / 0.01), len(path), request) AS INTEGER) AS rank FROM ep")
def srt_7(spark, d):
    """Quantised tolerances: a hundredth of repeated edges, then a whole unit of weight.

    Ranks go on from the rows of smaller classes: classes of ids in ranges, so that no task
    ranks more than 2**16 rows, and only their counts are summed up in one.
    """
    dup = F.floor((1 - F.size(F.array_distinct("path")) / F.size("path")) / 0.01)
    key = ["dup", "edges", "range"]
    p = kept(event_paths(spark, d).select("request", dup.alias("dup"), F.size("path").alias("edges"), F.floor(F.col("request") / 2**16).alias("range")))
    below = F.coalesce(F.sum("n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = p.groupBy(*key).agg(F.count("*").alias("n")).select(*key, below.alias("below"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("request"))
    return p.withColumn("own", own).join(classes, key).select("request", (F.col("below") + F.col("own")).cast("int").alias("rank"))
