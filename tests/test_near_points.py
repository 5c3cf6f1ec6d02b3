"""Pairs within a distance, everywhere on the globe, against all pairs."""

import math
import random

import pytest

from cairn.functions.geo import EARTH_M
from cairn.operators.graph import snap
from cairn.operators.spatial import asking_cells, holding_cells, near_points

RNG = random.Random(12)


def metres(a, b):
    x, y = math.radians(a[1]), math.radians(b[1])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1, h)))


def around(lng, lat, n, degrees):
    wide = degrees / max(math.cos(math.radians(lat)), 1e-3)
    return [((lng + RNG.uniform(-wide, wide) + 180) % 360 - 180, max(-90.0, min(90.0, lat + RNG.uniform(-degrees, degrees)))) for _ in range(n)]


@pytest.mark.parametrize(("limit", "size"), [(500.0, 0.01), (4000.0, 0.05), (4.0, 4e-5)])
def test_near_points_equal_all_pairs(spark, limit, size):
    spread = limit / 30_000
    points = [p for lng, lat in [(9, 46), (20, 70), (-179.9999, 70), (180, 0), (0, 89.999), (77, -90), (0, 0), (-120, -60.001), (33, 85)] for p in around(lng, lat, 40, spread)]
    points += [(180.0, 10.0), (-180.0, 10.0), (0.0, 90.0), (123.0, 90.0)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0)], "id long, lng double, lat double")
    right = left.toDF("other", "other_lng", "other_lat")
    found = sorted((r.id, r.other) for r in near_points(left, right, limit, size).collect())
    sure = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if metres(p, q) <= limit * (1 - 1e-9)}
    maybe = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if metres(p, q) <= limit * (1 + 1e-9)}
    assert len(found) == len(set(found)) and sure <= set(found) <= maybe and len(sure) > 2 * len(points)


def test_snapping_across_the_date_line(spark):
    nodes = spark.createDataFrame([(1, -179.9995, 70.0), (2, 179.998, 70.0), (3, 179.0, 70.0)], "node long, lng double, lat double")
    points = spark.createDataFrame([(7, 179.9999, 70.0)], "point long, lng double, lat double")
    assert [(r.node, r["rank"]) for r in snap(points, nodes).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_first_near_of_lists_and_of_all_rows(spark):
    """The least rows of a key within reach, whether a cell's short list proves them or not."""
    from cairn.operators.match import first_near

    at = lambda: (9.0 + RNG.randrange(40) / 500, 46.0 + RNG.randrange(40) / 500)
    held = [(*at(), "ab"[n % 2], n) for n in range(400)]
    asked = [(*at(), "abc"[n % 3]) for n in range(60)]
    found = first_near(spark.createDataFrame(asked, "lng double, lat double, key string").distinct(), spark.createDataFrame(held, "other_lng double, other_lat double, key string, h long"), 2000, 3, 0.05, listed=8)
    got = {(r["lng"], r["lat"], r["key"]): r["first"] for r in found.collect() if r["first"]}
    want = {}
    for x, y, key in asked:
        near = sorted(h for a, b, k, h in held if k == key and metres((x, y), (a, b)) <= 2000)[:3]
        if near:
            want[x, y, key] = near
    assert got == want and any(len(v) == 3 for v in want.values())


def test_fallback_among_more_than_a_list(spark):
    """One place with a hundred highlights: those that share a word come first, the POI's own one is left out, and only the first six count."""
    from cairn.operators import match

    titles = [(n, "Rifugio Alto" if n in (40, 70, 90) else "Nulla", n % 4, 9.0, 46.0) for n in range(100)]
    lights = spark.createDataFrame(titles, "highlight_id long, title string, seq long, other_lng double, other_lat double")
    pois = spark.createDataFrame([(1, "Rifugio Basso", 9.0, 46.0), (2, None, 9.0, 46.0), (3, "Rifugio Alto", 9.0, 46.01)], "id long, name string, lng double, lat double")
    own = spark.createDataFrame([(1, 40)], "id long, highlight_id long")
    order = lambda shares: [h for _, _, h in sorted((0 if shares and t != "Nulla" else 1, s, h) for h, t, s, _, _ in titles)]
    for tours in (range(100), [90], [4], [20], [99]):
        want = {}
        for i, shares, mine in ((1, True, 40), (2, False, None), (3, True, None)):
            first = [h for h in [h for h in order(shares) if h != mine][:6] if h in set(tours)]
            if first:
                want[i] = first[0]
        found = match.fallback_highlight(pois, lights, own, lights.filter(lights["highlight_id"].isin(list(tours))))
        assert {r["id"]: r["highlight_id"] for r in found.collect()} == want
    best = {r["id"]: (r["highlight_id"], r["tier"]) for r in match.highlight_match(pois, lights).collect()}
    assert best == {3: (40, 2)}


def test_points_past_a_pole_meet_few(spark):
    """The meshes of many suppliers lie at latitudes of over 90 degrees, in bands of which each was one cell."""
    points = [(n, 9 + n / 20 + RNG.uniform(0, 0.005), lat + RNG.uniform(0, 0.005)) for lat in (120.0, 268.0, 301.0) for n in range(200)]
    points += [(n, RNG.uniform(0, 360), 90 + RNG.uniform(0, 0.02)) for n in range(60)]
    points = [(i, x, y) for i, (_, x, y) in enumerate(points)]
    left = spark.createDataFrame(points, "id long, lng double, lat double")
    right = left.toDF("other", "other_lng", "other_lat")
    found = {(r.id, r.other) for r in near_points(left, right, 500.0).collect()}
    assert found == {(i, j) for i, *p in points for j, *q in points if metres(p, q) <= 500.0} and len(found) > 2 * len(points)
    far = left.filter("id < 600")
    assert asking_cells(far, 500.0).join(holding_cells(right.filter("other < 600")), "cell").count() < 10 * 600
