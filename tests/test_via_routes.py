"""Routes through several places against a plain search over the same graph."""

import heapq
import random
from itertools import permutations, product

import pytest

from cairn.operators import graph, routes, via_routes

RNG = random.Random(6)
NODES = [(r * 4 + c, float(c), float(r)) for r in range(3) for c in range(4)]
EDGES = []
for n, x, y in NODES:
    for m in ([n + 1] if x < 3 else []) + ([n + 4] if y < 2 else []):
        EDGES.append((len(EDGES), n, m, round(RNG.uniform(5, 60), 3)))
WEIGHT = {e: w for e, _, _, w in EDGES}
AROUND = {n: [] for n, _, _ in NODES}
for e, a, b, w in EDGES:
    AROUND[a].append((e, b, w))
    AROUND[b].append((e, a, w))


def walk(a, b, dear):
    heap, seen = [(0.0, [], a)], set()
    while heap:
        cost, path, n = heapq.heappop(heap)
        if n == b:
            return path
        if n not in seen:
            seen.add(n)
            for e, m, w in AROUND[n]:
                heapq.heappush(heap, (cost + w * (8 if e in dear else 1), [*path, e], m))


def overlap(p, q):
    return sum(e in p for e in q) / max(len(p), len(q))


def ways(a, b, dear):
    out = [walk(a, b, dear)]
    while len(out) < 4:
        p = walk(a, b, dear | {e for q in out for e in q})
        if overlap(out[0], p) >= 0.7:
            break
        out.append(p)
    return out


def length(p):
    return sum(WEIGHT[e] for e in p)


def plain(source, vias, target):
    orders = list(permutations(vias))
    if len(vias) > 3:
        orders = [min(orders, key=lambda o: sum(length(walk(a, b, set())) for a, b in zip((source, *o), (*o, target), strict=True)))]
    found = []
    for o in orders:
        legs = list(zip((source, *o), (*o, target), strict=True))
        routes = [sum((walk(a, b, set()) for a, b in legs), [])]

        def go(k, path):
            if len(routes) < 48:
                if k == len(legs):
                    routes.append(path)
                else:
                    for p in ways(*legs[k], set(path)):
                        go(k + 1, path + p)

        go(0, [])
        (x0, y0), (x1, y1) = ((n % 4, n // 4) for n in (source, target))
        at = [(n % 4 - x0) * (x1 - x0) + (n // 4 - y0) * (y1 - y0) for n in o]
        turned = sum(a > b for a, b in zip(at, at[1:], strict=False)) / max(1, len(at) - 1)
        found += [(round(100 * (len(p) - len(set(p))) / len(p)), round(length(p)), turned, length(p), p) for p in routes]
    kept = []
    for *_, p in sorted(found):
        if kept and (len(p) - len(set(p))) / len(p) > 0.1:
            continue
        if all(overlap(q, p) < 0.7 for q in kept):
            kept.append(p)
    return kept[:4]


@pytest.fixture(scope="module")
def tables(spark):
    both = [(e, a, b, w) for e, a, b, w in EDGES] + [(e, b, a, w) for e, a, b, w in EDGES]
    return spark.createDataFrame(both, "edge long, a long, b long, weight double").cache(), spark.createDataFrame(NODES, "node long, lng double, lat double").cache()


def test_routes_through_all_places(spark, tables):
    asked = [(1, 0, [6], 11), (2, 0, [9, 2], 7), (3, 4, [3, 3], 8), (4, 0, [], 11)]
    found = via_routes.through_all(spark.createDataFrame(asked, "request long, source long, vias array<long>, target long"), *tables).collect()
    for i, source, vias, target in asked:
        own = [r.path for r in sorted((r for r in found if r.request == i), key=lambda r: r.alt)]
        assert own == (plain(source, vias, target) if len(set(vias)) == len(vias) > 0 else [])


def test_four_places_go_in_the_shortest_order(spark, tables):
    edges, _ = tables
    asked = [(1, 1, [8, 3, 5, 10], 11), (2, 0, [9, 2, 7], 4)]
    requests = spark.createDataFrame(asked, "request long, source long, vias array<long>, target long")
    found = via_routes.plain_routes(via_routes.orderings(requests), routes.uncontracted(edges)).collect()
    for i, source, vias, target in asked:
        every = [list((source, *o, target)) for o in permutations(vias)]
        ways_of = lambda o: [p for a, b in zip(o, o[1:], strict=False) for p in walk(a, b, set())]
        own = [r for r in found if r.request == i]
        assert sorted(r.places for r in own) == sorted(every if len(vias) <= 3 else [min(every, key=lambda o: length(ways_of(o)))])
        assert all([s.edge for s in r.steps] == ways_of(r.places) for r in own)


def test_best_choice_of_places(spark, tables):
    """Choices in order of the lists, each against the best so far, within a hundredth by length."""
    asked = [(1, 0, [[6, 9], [2]], 11), (2, 3, [[4, 5, 8]], 7), (3, 0, [[0]], 6)]
    found = via_routes.through_best(spark.createDataFrame(asked, "request long, source long, candidates array<array<long>>, target long"), *tables).collect()
    dup = lambda p: (len(p) - len(set(p))) / len(p)
    for i, source, lists, target in asked[:2]:
        best = None
        for vias in product(*lists):
            routes = plain(source, list(vias), target)
            if not best or (dup(routes[0]) < best[0] if abs(dup(routes[0]) - best[0]) > 0.01 else length(routes[0]) < best[1]):
                best = dup(routes[0]), length(routes[0]), list(vias), routes
        own = sorted((r for r in found if r.request == i), key=lambda r: r.alt)
        assert own and all(r.vias == best[2] for r in own)
        assert [r.path for r in own] == best[3]
    assert not [r for r in found if r.request == 3]


def test_a_rule_that_is_no_order(spark):
    rows = [(1, 10, [0], 0.30, 5.0), (1, 11, [1], 0.295, 9.0), (1, 12, [2], 0.285, 7.0), (1, 13, [3], 0.28, 6.9), (1, 14, [4], 0.292, 1.0), (2, 20, [0], 0.0, 1.0)]
    found = via_routes.best_of(spark.createDataFrame(rows[::-1], "request long, choice long, order array<int>, dup double, length double")).collect()
    assert {r.request: r.choice for r in found} == {1: 13, 2: 20}


def test_too_many_places_are_an_error(spark, tables):
    with pytest.raises(ValueError):
        via_routes.through_all(spark.createDataFrame([(1, 0, [1, 2, 3, 5, 6], 11)], "request long, source long, vias array<long>, target long"), *tables)


def test_chains_are_one_edge_and_come_apart_again(spark):
    """Long chains between few junctions, a ring, a chain back to where it began, and an end within a chain."""
    rng, rows, n = random.Random(2), [], 100
    for a, b in [(0, 1), (1, 2), (0, 2), (2, 3), (0, 3), (3, 3), (50, 50)]:
        stops = [a, *range(n, n + rng.randrange(3, 40)), b]
        n = stops[-2] + 1
        rows += [(x, y, float(rng.randint(1, 9))) for x, y in zip(stops, stops[1:], strict=False)]
    edges = graph.simple_edges(spark.createDataFrame(rows, "a long, b long, weight double")).cache()
    weight = {frozenset((a, b)): w for a, b, w in rows}
    asked = [(1, 0, 2), (2, 1, 3), (3, 105, 1), (4, 50, 50 if n < 0 else 0), (5, rows[12][0], rows[14][1])]
    net, chains = routes.contracted(edges, routes.ends_of(spark.createDataFrame(asked, "request long, source long, target long")))
    assert net.count() <= 2 * 10
    found = {r.request: r for r in routes.shortest(spark.createDataFrame(asked, "request long, source long, target long"), edges).collect()}
    around = {}
    for a, b, w in rows:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    for i, s, t in asked:
        far, heap = {s: 0}, [(0, s)]
        while heap:
            c, x = heapq.heappop(heap)
            for y, w in around[x]:
                if c + w < far.get(y, 1e9):
                    far[y] = c + w
                    heapq.heappush(heap, (c + w, y))
        assert (i in found) == (t in far)
        if i in found:
            r = found[i]
            assert r.length == far[t] and (r.stops[0], r.stops[-1]) == (s, t) and len(r.path) == len(r.stops) - 1
            assert sum(weight[frozenset(p)] for p in zip(r.stops, r.stops[1:], strict=False)) == far[t]


def test_long_routes_are_put_together_of_parts(spark, monkeypatch):
    monkeypatch.setattr(routes, "CARRIED", 2)
    # A ladder: every rung is a junction.
    rows = [(i, i + 1, 1.0) for i in range(9)] + [(i + 20, i + 21, 1.0) for i in range(9)] + [(i, i + 20, 0.5) for i in range(10)]
    edges = graph.simple_edges(spark.createDataFrame(rows, "a long, b long, weight double"))
    r = routes.shortest(spark.createDataFrame([(1, 0, 29), (2, 0, 1)], "request long, source long, target long"), edges).collect()
    found = {x.request: x for x in r}
    assert found[1].length == 9.5 and len(found[1].path) == 10 and found[1].stops[0] == 0 and found[1].stops[-1] == 29
    assert found[2].path and found[2].length == 1.0
