"""Cases with known answers, and operators against plain Python."""

import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import geo, pages, text
from cairn.operators import components, graph, match, routes, search
from cairn.operators.lines import centroids
from cairn.sources import osm, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_elevation_prefix(spark):
    df = spark.createDataFrame([("2650 m",), ("N/D",), ("",), ("0",), (None,)], "t string")
    assert [r.x for r in df.select(text.leading_int("t").alias("x")).collect()] == [2650, None, None, None, None]


def test_polygon_with_hole(spark):
    ring = lambda a, z: [(a, a), (z, a), (z, z), (a, z), (a, a)]
    kind = "x double, y double, rings array<array<struct<lng:double,lat:double>>>"
    rings = [ring(0.0, 10.0), ring(4.0, 6.0)]
    df = spark.createDataFrame([(5.0, 5.0, rings), (4.0, 5.0, rings), (10.0, 10.0, rings), (1.0, 1.0, rings), (11.0, 1.0, rings)], kind)
    assert [r.x for r in df.select(geo.point_in_rings("x", "y", F.col("rings")).alias("x")).collect()] == [False, True, True, True, False]


def test_line_through_box(spark):
    kind = "line array<struct<lng:double,lat:double>>"
    df = spark.createDataFrame([([(-1.0, 0.5), (2.0, 0.5)],), ([(-0.5, 0.8), (0.5, 2.0)],), ([(0.5, 0.5)],)], kind)
    assert [r.x for r in df.select(geo.line_meets_box("line", 0.0, 0.0, 1.0, 1.0).alias("x")).collect()] == [True, False, True]


def test_centroid(spark):
    v = spark.createDataFrame([(1, "a", 1, 0.0, 0.0), (1, "a", 2, 2.0, 0.0), (2, "a", 1, 0.0, 1.0), (2, "a", 2, 0.0, 2.0)], "line long, name string, pos int, lng double, lat double")
    c = centroids(v, "line", ["name"]).first()
    assert abs(c.lng - 2 / 3) < 1e-12 and abs(c.lat - 0.5) < 1e-12


def test_grade_ranges(spark):
    tokens = lambda a, z: one(spark, text.grade_tokens(F.lit(a).cast("string"), F.lit(z).cast("string")))
    assert set(tokens("D", "F")) == set(tokens("D", None)) == set(tokens("4", None)) == {"D", "E", "F", "4", "5", "6"}
    assert tokens("F", "A") is None
    assert set(tokens("Z", "B")) == {"A", "B", "1", "2"}


def test_filter_limits_and_bounds(spark):
    raw = [json.dumps({"limit": x}) for x in (999, -5, None, "7")] + ["{}", json.dumps({"minElevation": 900, "maxElevation": 500, "types": ["hut", "hut", "x"]})]
    f = search.filters(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "filter_id int, json string")).orderBy("filter_id").collect()
    assert [r.limit for r in f[:5]] == [50, 1, 50, 7, 50]
    assert f[5].types == ["hut"] and f[5].min_elevation == 900 and f[5].max_elevation is None


def test_json_in_prose(spark):
    assert one(spark, search.json_in(F.lit('Ecco: ```json\n{"a": {"b": 1}}\n``` fine'))) == '{"a": {"b": 1}}'
    assert one(spark, search.json_in(F.lit("niente"))) is None


def test_truncation(spark):
    cut = lambda t, n: one(spark, text.truncate_words(F.lit(t), n))
    assert (cut("alpha beta", 5), cut("alpha beta", 7), cut("abcdefgh", 3)) == ("alpha", "alpha", "abc")


def test_name_tiers(spark):
    tier = lambda a, b: one(spark, text.name_tier(F.lit(a), F.lit(b)))
    assert tier("Rifugio Curò", "rifugio curo") == 1
    assert tier("Rifugio Curò", "Rifugio Antonio Curò") == 2
    assert tier("Rifugio Curò", "Baita Curò") == 3
    assert tier("Rifugio Curò", "Rifugio Albani") is None


def test_place_choice(spark):
    found = lambda rows: [(r.id, r.place_id) for r in match.choose(spark.createDataFrame(rows, "id int, place_id int, tier int, metres int")).collect()]
    assert found([(1, 1, 3, 5), (1, 2, 3, 9)]) == []
    assert found([(1, 1, 3, 5)]) == [(1, 1)]
    assert found([(1, 1, 2, 50), (1, 2, 3, 5)]) == [(1, 1)]
    assert found([(1, 1, 1, 120), (1, 2, 3, 5)]) == [(1, 1)]


def test_sanitising(spark):
    clean = lambda t: one(spark, pages.sanitised(F.lit(t)))
    assert clean("<think>x\ny</think>```html\nEcco <p>Ciao</p>\n```") == "<p>Ciao</p>"
    assert clean("solo testo") == "solo testo"


def test_upsert_keeps_elevation(spark):
    old = spark.createDataFrame([(1, "a", 1200), (2, "b", None)], "osm_id long, name string, elevation int")
    new = spark.createDataFrame([(1, "c", None, 1), (3, "d", 7, 2), (3, "e", None, 3)], "osm_id long, name string, elevation int, seq long")
    assert sorted(map(tuple, sinks.coalescing_upsert(old, new, "osm_id", "seq", "elevation").collect())) == [(1, "c", 1200), (2, "b", None), (3, "e", 7)]
    assert sorted(map(tuple, sinks.upsert(old, new, "osm_id", "seq").collect()), key=str) == [(1, "c", None), (2, "b", None), (3, "e", None)]
    assert sorted(r.name for r in sinks.insert_absent(old, new, "osm_id", "seq").collect()) == ["a", "b", "d"]


def test_quota(spark):
    calls = spark.range(151).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "date'2024-01-01' as day", "date'2024-01-01' as month")
    assert match.admitted(calls).count() == 150


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = components.connected_components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in parent}


def line(points, osm_id):
    return [(osm_id, i, x, y) for i, (x, y) in enumerate(points)]


def test_gap_is_bridged_but_stubs_are_not(spark):
    main = line([(9.6 + k / 1000, 46.0) for k in range(101)], 1)
    other = line([(9.6 + k / 1000, 45.9998 if k == 50 else 45.998) for k in range(101)], 2)
    stubs = line([(9.0, 45.0), (9.0, 45.001)], 3) + line([(9.0002, 45.0), (9.0002, 44.999)], 4)
    v = spark.createDataFrame(main + other + stubs, "osm_id long, pos int, lng double, lat double")
    nodes = graph.nodes_of(v)
    edges = graph.edges_of(v, graph.merged(nodes))
    found = graph.bridges(graph.component_sizes(nodes, edges)).collect()
    assert len(found) == 1 and 20 < found[0].weight < 24


def test_close_nodes_merge_greedily(spark):
    v = spark.createDataFrame(line([(9.0, 46.0), (9.00002, 46.0), (9.00004, 46.0), (9.1, 46.0)], 1), "osm_id long, pos int, lng double, lat double")
    nodes = graph.nodes_of(v)
    leaders = {r.node: r.leader for r in graph.merged(nodes).collect()}
    # The second joins the first; the third is within reach of the second alone, which leads nothing.
    assert len(leaders) == 4 and sorted(leaders.values()).count(min(leaders)) in (2, 3)


def test_shortest_paths_equal_dijkstra(spark):
    rng = random.Random(4)
    raw = {(min(a, b), max(a, b)): rng.randint(1, 20) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(45)) if a != b}
    edges = graph.simple_edges(spark.createDataFrame([(a, b, float(w)) for (a, b), w in raw.items()], "a long, b long, weight double")).cache()
    asked = [(i, rng.randrange(20), rng.randrange(20)) for i in range(12)]
    found = {r.request: r for r in routes.shortest(spark.createDataFrame(asked, "request long, source long, target long"), edges).collect()}
    near: dict[int, list] = {}
    for (a, b), w in raw.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    for i, s, t in asked:
        far, heap = {s: 0}, [(0, s)]
        while heap:
            c, x = heapq.heappop(heap)
            for y, w in near.get(x, []):
                if c + w < far.get(y, 1e9):
                    far[y] = c + w
                    heapq.heappush(heap, (c + w, y))
        assert (i in found) == (s != t and t in far)
        if i in found:
            assert found[i].length == far[t] and found[i].stops[0] == s and found[i].stops[-1] == t


def test_alternatives_differ(spark):
    # A diamond with a short and a long side.
    rows = [(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.5), (3, 4, 1.5)]
    edges = graph.simple_edges(spark.createDataFrame(rows, "a long, b long, weight double")).cache()
    asked = spark.createDataFrame([(7, 1, 4)], "request long, source long, target long")
    assert sorted((r.alt, r.length) for r in routes.alternatives(asked, edges).collect())[:2] == [(0, 2.0), (1, 3.0)]
    trip = routes.round_trip(asked, edges).first()
    assert (trip.out_length, trip.back_length, trip.only_one_path) == (2.0, 3.0, False)


def test_osm_relations_and_ways(spark):
    ways = spark.createDataFrame([(0, 10, [1, 2], {}), (1, 11, [1, 9], {})], "seq int, id long, nodes array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(1, 46.0, 9.0), (2, 46.1, 9.1)], "id long, lat double, lon double")
    assert [r.id for r in osm.way_lines(ways, nodes).collect()] == [10]
    rel = spark.createDataFrame([(0, 5, [("way", 10, "")], {"route": "via_ferrata", "name": "A"}), (1, 6, [("way", 10, "")], {"route": "via_ferrata", "name": "B"})], "seq int, id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    got = {r.id: (r.relation_ids, r.rel_tags and r.rel_tags["name"]) for r in osm.with_relations(ways, rel).collect()}
    assert got == {10: ([5, 6], "A"), 11: (None, None)}


def test_gpx_drops_repeated_points(spark):
    points = F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(46.0).alias("lat")) for x in (9.0, 9.0, 9.1)))
    out = one(spark, sinks.gpx(F.lit("A & B"), points))
    assert out.count("<trkpt") == 2 and "A &amp; B" in out and 'lat="46.0000000"' in out


def test_rounds_give_the_whole_result_or_an_error(spark):
    """Too few rounds are an error, never a part of the nodes, components or routes."""
    from cairn.operators.components import connected_components
    from cairn.operators.graph import merged
    from cairn.operators.routes import shortest

    # A track with a vertex every 2.5 m: each node waits for the one before it.
    track = spark.createDataFrame([(i, 9.0, 46.0 + i * 2.25e-5, (1, i)) for i in range(8)], "node long, lng double, lat double, seen struct<k:long,pos:long>")
    with pytest.raises(RuntimeError):
        merged(track, max_rounds=3)
    assert {r.node: r.leader for r in merged(track).collect()} == {i: i - i % 2 for i in range(8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)
    steps = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(9)], "edge long, a long, b long, weight double")
    asked = spark.createDataFrame([(1, 0, 9)], "request long, source long, target long")
    with pytest.raises(RuntimeError):
        shortest(asked, steps, max_rounds=5)
    assert shortest(asked, steps).first().cost == 9.0


def test_posts_that_hold_the_whole_name(spark):
    """Names without core tokens, and names that end or begin inside a word."""
    pois = spark.createDataFrame([(1, "hut", "Rifugio"), (2, "peak", "Monte Ros"), (3, "peak", "Pià"), (4, "peak", None), (5, "peak", " ")], "id long, type string, name string")
    posts = spark.createDataFrame([(1, "al rifugio oggi"), (2, "sul Monte Rosso!"), (3, "piano piano"), (4, None)], "post_id long, post string")
    assert {tuple(r) for r in match.relevant_posts(pois, posts).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_posts_are_dealt_once_and_not_for_each_text(spark):
    """Ids and posts of names that say the same meet in cells; an id of two names and a post of two texts give each pair once."""
    pois = [(i, ["hut", "bivouac", "peak"][i % 3], f"{['Rifugio', 'Bivacco', 'Monte'][i % 3]} red bolt {i % 7}") for i in range(300)] + [(300, "peak", "Monte Blu"), (300, "peak", "Monte red bolt 1"), (301, None, "blu alto"), (302, "peak", None)]
    posts = [(n, f"Ieri al red bolt {n % 20}{' e blu' if n % 5 == 0 else ''}!") for n in range(200)] + [(200, "il blu alto"), (200, "red bolt"), (201, None)]
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(r.stageId(), r.attemptId()): r.shuffleWriteRecords() for r in (found.apply(k) for found in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for k in range(found.size()))}
    before = set(stages())
    found = [tuple(r) for r in match.relevant_posts(spark.createDataFrame(pois, "id long, type string, name string"), spark.createDataFrame(posts, "post_id long, post string")).collect()]
    by_bolt = {(i, n) for i in range(301) for n in range(201)}
    by_blu = {(300, n) for n in range(0, 201) if n % 5 == 0} | {(301, 200)}
    assert len(found) == len(set(found)) and set(found) == by_bolt | by_blu
    # The different names and texts that fit are 21 x 21; an id for each text would be 300 x 21 rows.
    written = [n for stage, n in stages().items() if stage not in before]
    assert written and max(written) < 2000


def test_pairs_of_kinds_in_many_cells(spark):
    """Every id and post whose asker and teller fit share one cell, others none, however small the cells."""
    rng = random.Random(4)
    fits = sorted({(rng.randrange(6), rng.randrange(5)) for _ in range(12)} | {(7, t) for t in range(5)})
    left = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 7, 9])) for i in range(150)]
    right = [(n, rng.choice([0, 0, 1, 2, 3, 4, 8])) for n in range(130)]
    want = sorted((i, n) for i, a in left for n, t in right if (a, t) in set(fits))
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    for least, most in ((1 << 12, 1 << 16), (1, 7), (1, 1)):
        ids, told = match.dealt(made(left, "id long, asker long"), made(right, "post_id long, teller long"), made(fits, "asker long, teller long"), cells=9, least=least, most=most)
        assert sorted(map(tuple, ids.join(told, "cell").select("id", "post_id").collect())) == want
    none = match.dealt(made(left, "id long, asker long"), made([], "post_id long, teller long"), made(fits, "asker long, teller long"))
    assert none[0].count() == none[1].count() == 0


def test_chunks_cover_all_points(spark):
    from cairn.plans.searches import grid

    points = spark.createDataFrame([(9.0, 46.0), (9.12, 46.01), (9.03, 46.05)], "lng double, lat double")
    chunks = grid(points, 0.05, 0.02).collect()
    assert sorted(c.chunk_id for c in chunks) == list(range(9))
    assert all(any(c.minx <= x <= c.maxx and c.miny <= y <= c.maxy for c in chunks) for x, y in points.collect())
    assert grid(points.limit(1), 0.05, 0.02).count() == 1 and grid(points.limit(0), 0.05, 0.02).count() == 0


def test_figures_and_generated_text(spark):
    from cairn.functions.pages import sanitised, stats

    page = "<b>Dislivello</b>:&nbsp;<i>450&#160;m</i> &amp; Lunghezza 3,5&amp;nbsp;km Ferrata: 2h30m"
    said = ["<think>a\n<p>b</p></think>\n```html\nEcco:\n<H2 class='x'>T</H2>\n<p>c</p>\n```\n", "```\nplain\n```", " no tag \n", "", None]
    df = spark.createDataFrame([(page, x) for x in said], "page string, said string")
    found = df.select(stats("page"), sanitised("said")).collect()
    assert found[0][0] == "Dislivello: 450 m | Lunghezza: 3,5 km | Durata ferrata: 2h30m"
    assert [r[1] for r in found] == ["<H2 class='x'>T</H2>\n<p>c</p>", "plain", "no tag", "", None]


def test_best_snapped_is_the_best_of_all_pairs(spark):
    """All sources searched at once: equal lengths, sources that are targets too, and targets out of reach."""
    from pyspark.sql import functions as F

    from cairn.operators import routes

    # A grid of 4 by 4 of equal weights, and a node apart.
    links = [(4 * y + x, 4 * y + x + 1, 1.0) for y in range(4) for x in range(3)] + [(4 * y + x, 4 * y + x + 4, 1.0) for y in range(3) for x in range(4)] + [(20, 21, 1.0)]
    edges = spark.createDataFrame([(n, *e, w) for n, (a, b, w) in enumerate(links) for e in ((a, b), (b, a))], "edge long, a long, b long, weight double")
    from_ = {1: [0, 1, 4], 2: [3, 12], 3: [0, 5], 4: [20, 0], 5: [20], 6: [7]}
    to = {1: [15, 11, 14], 2: [0, 15], 3: [5, 0, 10], 4: [21, 15], 5: [3], 6: [7]}
    as_rows = lambda d: spark.createDataFrame([(r, n) for r, ns in d.items() for n in ns], "request long, node long")
    found = {r["request"]: tuple(r)[1:] for r in routes.best_snapped(as_rows(from_), as_rows(to), edges).collect()}
    pairs = spark.createDataFrame([(n, r, a, b) for n, (r, a, b) in enumerate((r, a, b) for r in from_ for a in from_[r] for b in to[r] if a != b)], "request long, own long, source long, target long")
    each = routes.shortest(pairs.drop("own"), edges).join(pairs, "request")
    best = each.groupBy("own").agg(F.min(F.struct("length", "source", "target", "path", "stops")).alias("m")).select("own", "m.*")
    assert found == {r["own"]: tuple(r)[1:] for r in best.collect()} and set(found) == {1, 2, 3, 4}
    once = routes.spread(spark.createDataFrame([(1, 0), (1, 3)], "request long, source long"), spark.createDataFrame([(1, 11)], "request long, node long"), routes.uncontracted(edges))
    assert [(r["source"], r["length"]) for r in once.collect()] == [(3, 2.0)]
