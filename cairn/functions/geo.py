"""Geometry on longitude and latitude in degrees, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
DEGREE_M = 111320.0


def col(c: Column | str | float) -> Column:
    return F.lit(c) if isinstance(c, int | float) else F.col(c) if isinstance(c, str) else c


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def haversine(lng1, lat1, lng2, lat2) -> Column:
    """SCL-1: metres between two points on a sphere."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lng2) - col(lng1)) / 2), F.lit(2))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    """SCL-2: initial bearing in degrees from 0 to 360."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lng2) - col(lng1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def between(a, b, share) -> Column:
    """SCL-3: the value at a share of the way from a to b."""
    return col(a) + (col(b) - col(a)) * col(share)


def node_key(lng, lat) -> Column:
    """SCL-4: both coordinates in units of 1e-5 degrees, packed into a long that keeps their order."""
    return round_half_up(col(lng) * 1e5) * F.lit(1 << 32) + round_half_up(col(lat) * 1e5) + F.lit(1 << 31)


def key_text(lng, lat) -> Column:
    return F.concat_ws("_", round_half_up(col(lng) * 1e5), round_half_up(col(lat) * 1e5))


def cell(x, size: float) -> Column:
    """SCL-5: number of the grid cell of a width of 1 / size cells a degree or size degrees."""
    return F.floor(col(x) / size)


def cell_id(cx: Column, cy: Column) -> Column:
    """One long for a cell's two numbers."""
    return (cx * F.lit(1 << 24) + cy).cast("long")


def around(lng, lat, metres: float) -> Column:
    """SCL-6: the box of metres to each side of a point."""
    dy = F.lit(metres / DEGREE_M)
    dx = F.lit(metres) / (F.lit(DEGREE_M) * F.cos(F.radians(col(lat))))
    return F.struct((col(lng) - dx).alias("minx"), (col(lat) - dy).alias("miny"), (col(lng) + dx).alias("maxx"), (col(lat) + dy).alias("maxy"))


def tile_x(lng, zoom) -> Column:
    """SCL-7: column of the map tile."""
    return F.floor((col(lng) + 180) / 360 * F.pow(F.lit(2.0), col(zoom)))


def tile_y(lat, zoom) -> Column:
    """SCL-7: row of the map tile."""
    r = F.radians(col(lat))
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * F.pow(F.lit(2.0), col(zoom)))


def valid_bbox(minx, miny, maxx, maxy) -> Column:
    """FLT-1: finite, in range, and of positive width and height; texts are read as numbers."""
    v = [F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c for c in (minx, miny, maxx, maxy)]
    finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in v]
    ok = finite[0] & finite[1] & finite[2] & finite[3]
    inside = v[0].between(-180, 180) & v[2].between(-180, 180) & v[1].between(-90, 90) & v[3].between(-90, 90)
    return F.coalesce(ok & (v[0] < v[2]) & (v[1] < v[3]) & inside, F.lit(False))


def point_in_box(lng, lat, minx, miny, maxx, maxy) -> Column:
    """FLT-4: border included."""
    return col(lng).between(col(minx), col(maxx)) & col(lat).between(col(miny), col(maxy))


def segment_meets_box(ax, ay, bx, by, minx, miny, maxx, maxy) -> Column:
    """FLT-5: exact, by separating axes: both coordinate axes, and the segment's normal."""
    ax, ay, bx, by, minx, miny, maxx, maxy = map(col, (ax, ay, bx, by, minx, miny, maxx, maxy))
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (minx, maxx) for y in (miny, maxy)]
    apart = (F.least(*side) > 0) | (F.greatest(*side) < 0)
    return (F.least(ax, bx) <= maxx) & (F.greatest(ax, bx) >= minx) & (F.least(ay, by) <= maxy) & (F.greatest(ay, by) >= miny) & ~apart


def segments(line) -> Column:
    """WIN-7: pairs of neighbouring vertices of an array of points, as a and b."""
    line = col(line)
    n = F.size(line) - 1
    return F.when(n > 0, F.zip_with(F.slice(line, 1, F.greatest(n, F.lit(0))), F.slice(line, 2, F.greatest(n, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<lng:double,lat:double>,b:struct<lng:double,lat:double>>>"))


def line_meets_box(line, minx, miny, maxx, maxy) -> Column:
    """FLT-5 for a whole line; one of a single vertex is tested as a point."""
    hit = F.exists(segments(line), lambda s: segment_meets_box(s["a"]["lng"], s["a"]["lat"], s["b"]["lng"], s["b"]["lat"], minx, miny, maxx, maxy))
    only = F.element_at(col(line), 1)
    return F.when(F.size(col(line)) == 1, point_in_box(only["lng"], only["lat"], minx, miny, maxx, maxy)).otherwise(hit)


def point_in_rings(lng, lat, rings) -> Column:
    """FLT-6: even-odd over all closed rings of a (multi)polygon, so holes count as outside; the border is inside."""
    x, y = col(lng), col(lat)
    edges = F.flatten(F.transform(col(rings), segments))

    def crosses(s):
        a, b = s["a"], s["b"]
        over = (a["lat"] > y) != (b["lat"] > y)
        return over & (x < (b["lng"] - a["lng"]) * (y - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"])

    def touches(s):
        a, b = s["a"], s["b"]
        turn = (b["lng"] - a["lng"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lng"])
        return (turn == 0) & x.between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"])) & y.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(edges, touches) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def segments_cross(s: Column, t: Column) -> Column:
    """Whether two segments share a point."""

    def turn(a, b, c):
        return F.signum((b["lng"] - a["lng"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lng"] - a["lng"]))

    def on(a, b, c):
        return (turn(a, b, c) == 0) & c["lng"].between(F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"])) & c["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    a, b, c, d = s["a"], s["b"], t["a"], t["b"]
    proper = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return proper | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)


def line_meets_rings(line, rings) -> Column:
    """FLT-7: a vertex inside, or a segment that crosses a ring's edge."""
    inside = F.exists(col(line), lambda p: point_in_rings(p["lng"], p["lat"], rings))
    edges = F.flatten(F.transform(col(rings), segments))
    return inside | F.exists(segments(line), lambda s: F.exists(edges, lambda t: segments_cross(s, t)))


def coordinate(c: Column) -> Column:
    """SCL-8: the first two numbers of an array as a point, null unless both are finite."""
    x, y = F.get(c, 0), F.get(c, 1)
    good = (F.size(c) >= 2) & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(good, F.struct(x.alias("lng"), y.alias("lat")))


def ring_of_box(minx, miny, maxx, maxy) -> Column:
    """SCL-37: the box as a closed ring."""
    at = lambda x, y: F.struct(col(x).alias("lng"), col(y).alias("lat"))
    return F.array(at(minx, miny), at(maxx, miny), at(maxx, maxy), at(minx, maxy), at(minx, miny))
