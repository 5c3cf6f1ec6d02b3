"""Searches in groups of small components against the rounds over the whole network."""

import pytest

from cairn.operators import graph, near_routes, routes, via_routes

#: Grids of four by four whose edges cost alike, so that many paths tie, and one of other costs.
ROWS = []
for g in range(3):
    for x in range(4):
        for y in range(4):
            at = 100 * g + 4 * x + y
            ROWS += [(at, at + 4, 1.0 if g < 2 else 1.0 + (at % 7) / 3)] if x < 3 else []
            ROWS += [(at, at + 1, 1.0 if g < 2 else 1.0 + (at % 5) / 3)] if y < 3 else []
ASKED = [(1, 0, 15), (2, 3, 12), (3, 100, 111), (4, 200, 215), (5, 203, 212), (6, 0, 115), (7, 5, 5), (8, 999, 0)]


@pytest.mark.parametrize("local", [0, 4096])
def test_groups_find_what_rounds_find(spark, monkeypatch, local):
    """All components by rounds, and all in groups; with equal costs, paths of several parts, no path and unknown ends."""
    for module in (routes, near_routes):
        monkeypatch.setattr(module, "CARRIED", 2)
    monkeypatch.setattr(near_routes, "LOCAL", local)
    monkeypatch.setattr(near_routes, "GROUP", 50)
    net = routes.uncontracted(graph.simple_edges(spark.createDataFrame(ROWS, "a long, b long, weight double"))).cache()
    asked = spark.createDataFrame(ASKED, "request long, source long, target long")
    as_set = lambda df: {(r.request, r.source, r.cost, r.length, r.alt, tuple(map(tuple, r.steps))) for r in df.collect()}
    found = as_set(near_routes.answered(asked, net, near_routes.dealt(net)))
    assert found == as_set(routes.further(asked, net))
    assert {r[0] for r in found} == {1, 2, 3, 4, 5}


def test_small_components_need_no_rounds(spark, monkeypatch):
    """Neither alternatives nor routes through places search the whole network by rounds, whose rows grew with each leg and round."""

    def none(*_, **__):
        raise AssertionError("rounds")

    monkeypatch.setattr(routes, "spread", none)
    edges = graph.simple_edges(spark.createDataFrame(ROWS, "a long, b long, weight double")).cache()
    nodes = spark.createDataFrame([(100 * g + 4 * x + y, float(x), float(y)) for g in range(3) for x in range(4) for y in range(4)], "node long, lng double, lat double")
    asked = spark.createDataFrame([(1, 200, [206, 213], 215)], "request long, source long, vias array<long>, target long")
    assert via_routes.through_all(asked, edges, nodes).count()
    assert routes.alternatives(spark.createDataFrame([(1, 200, 215)], "request long, source long, target long"), edges).count()


def test_trails_over_the_same_ground_make_no_more_edges(spark, tmp_path):
    """Orders whose keys differ by 200 are trails along the same places."""
    from cairn.operators import graph
    from cairn.plans import routing

    found = []
    for copies in (1, 20):
        rows = [(k * 200 + o, n, 1, 1) for k in range(copies) for o in (1, 2, 3) for n in (1, 2, 3, 4)]
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/{copies}/lineitem.parquet")
        _, edges = routing.network(spark, f"{tmp_path}/{copies}")
        found.append((edges.count(), sorted(map(tuple, graph.simple_edges(edges).collect()))))
    assert found[0] == found[1] and found[0][0] == 9
    _, raw = routing.network(spark, f"{tmp_path}/20", edges_of=graph.edges_of)
    assert raw.count() == 180 and sorted(map(tuple, graph.simple_edges(raw).collect())) == found[0][1]


def test_components_are_searched_on_the_contracted_network(spark, monkeypatch):
    """Routes through places of the meshes: each edge of the whole network was in every step of the components, both ways."""
    from cairn.plans import routing

    seen = []

    def counted(edges, *ends):
        seen.append(edges.count())
        return connected_components(edges, *ends)

    connected_components = near_routes.connected_components
    for module in (graph, near_routes):
        monkeypatch.setattr(module, "connected_components", counted)
    monkeypatch.setattr(via_routes, "through_all", lambda requests, edges, nodes: requests.selectExpr("request", "0 as alt", "0d as length", "0d as dup", "array(0) as path"))
    assert routing.grf_11(spark, "/root/testdata/sf0.001").count()
    assert not seen
    monkeypatch.undo()
    monkeypatch.setattr(near_routes, "connected_components", counted)
    rows = [(x, x + 1, 1.0) for x in range(40)] + [(x, x + 1, 1.0) for x in range(100, 140)] + [(0, 100, 1.0), (20, 120, 1.0), (40, 140, 1.0)]
    edges = graph.simple_edges(spark.createDataFrame(rows, "a long, b long, weight double"))
    nodes = spark.createDataFrame([(x, float(x), 0.0) for x in [*range(41), *range(100, 141)]], "node long, lng double, lat double")
    asked = spark.createDataFrame([(1, 0, [20], 40)], "request long, source long, vias array<long>, target long")
    found = via_routes.through_all(asked, edges, nodes).orderBy("alt").collect()
    assert seen == [5] and found[0].stops == list(range(41)) and found[0].length == 40.0


def test_chains_are_found_without_joins_of_edges(spark):
    """Each edge meets the node that it leads to, and what it is made of carries where it leads: before, edges were joined to edges before and after the rounds."""
    edges = graph.simple_edges(spark.createDataFrame(ROWS, "a long, b long, weight double"))
    _, chains = routes.contracted(edges, spark.createDataFrame([(0,), (15,)], "node long"))
    assert chains._jdf.queryExecution().analyzed().toString().count("Join") == 1
