"""Spatial joins as equi-joins on grid cells with an exact test behind them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import EARTH_M, cell, cell_id, haversine, line_meets_rings, point_in_box, point_in_rings, segment_meets_box
from cairn.operators.lines import lines, rings, vertex_pairs, with_cells

BOX_CELL = 0.1
SNAP_CELL = 0.01


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = BOX_CELL) -> DataFrame:
    """JOIN-6 for points: each point with each box that holds it, border included.

    Boxes have minx, miny, maxx, maxy; a point's cell is in exactly one row, so nothing repeats.
    """
    dealt = with_cells(boxes, size, "minx", "miny", "maxx", "maxy")
    keyed = points.withColumn("cell", cell_id(cell("lng", size), cell("lat", size)))
    return keyed.join(dealt, "cell").filter(point_in_box("lng", "lat", "minx", "miny", "maxx", "maxy")).drop("cell")


def lines_in_boxes(vertices: DataFrame, key: str, boxes: DataFrame, box_key: str, size: float = BOX_CELL) -> DataFrame:
    """JOIN-6 for lines: (key, box_key) of the lines with a segment that meets the box."""
    s = vertex_pairs(vertices, key)
    least = lambda a, b: F.least(a, b)
    s = s.withColumns({"x0": least("ax", "bx"), "y0": least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    s = with_cells(s, size, "x0", "y0", "x1", "y1")
    dealt = with_cells(boxes.select(box_key, "minx", "miny", "maxx", "maxy"), size, "minx", "miny", "maxx", "maxy")
    hit = s.join(dealt, "cell").filter(segment_meets_box("ax", "ay", "bx", "by", "minx", "miny", "maxx", "maxy"))
    return hit.select(key, box_key).distinct()


def points_in_areas(points: DataFrame, areas: DataFrame, key: list[str], size: float = BOX_CELL) -> DataFrame:
    """JOIN-5: each point with each area, of rows of key, ring, pos, lng, lat, that holds it."""
    box = areas.groupBy(*key).agg(F.min("lng").alias("minx"), F.min("lat").alias("miny"), F.max("lng").alias("maxx"), F.max("lat").alias("maxy"))
    shaped = rings(areas, key).join(box, key)
    dealt = with_cells(shaped, size, "minx", "miny", "maxx", "maxy")
    keyed = points.withColumn("cell", cell_id(cell("lng", size), cell("lat", size)))
    inside = point_in_box("lng", "lat", "minx", "miny", "maxx", "maxy") & point_in_rings("lng", "lat", F.col("rings"))
    return keyed.join(dealt, "cell").filter(inside).drop("cell", "rings", "minx", "miny", "maxx", "maxy")


def lines_in_areas(vertices: DataFrame, key: str, areas: DataFrame, area_key: str, size: float = BOX_CELL, tasks: int = 64) -> DataFrame:
    """(key, area_key) of the lines that meet an area: those that meet its box, met by cells, then by the exact test.

    The lines of one area are dealt over so many parts, to each of which its rings go.
    """
    box = areas.groupBy(area_key).agg(F.min("lng").alias("minx"), F.min("lat").alias("miny"), F.max("lng").alias("maxx"), F.max("lat").alias("maxy"))
    # A line of one vertex has no segment.
    near = lines_in_boxes(vertices, key, box, area_key, size).unionByName(points_in_boxes(vertices, box, size).select(key, area_key)).distinct()
    shaped = lines(vertices, key).join(near, key).withColumn("part", F.pmod(F.xxhash64(key), F.lit(tasks)))
    ringed = rings(areas, [area_key]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    return shaped.join(ringed, [area_key, "part"]).filter(line_meets_rings("line", F.col("rings"))).select(key, area_key)


def off_equator(lat: Column) -> Column:
    """Degrees from the equator; a latitude past a pole comes down on the other side."""
    return F.abs(F.pmod(lat + 90, F.lit(180.0)) - 90)


def columns_of(band: Column, size: float) -> Column:
    """Cells of a band of size degrees of latitude, none of which is narrower than the band is high."""
    low = band * size - 90
    far = F.greatest(off_equator(low), off_equator(low + size))
    return F.greatest(F.floor(360 * F.cos(F.radians(far)) / size), F.lit(1)).cast("long")


def asking_cells(left: DataFrame, metres: float, size: float = SNAP_CELL) -> DataFrame:
    """left's rows with each cell in which a point within metres of their (lng, lat) may be.

    The globe is cut into bands of size degrees, and each band into cells that widen with the
    latitude and close at 180 degrees; so a point asks about as many cells everywhere, next
    to a pole all of the few that a band has there.  A null coordinate is near nothing.
    """
    lng, lat = F.pmod(F.col("lng").cast("double") + 180, F.lit(360.0)), F.col("lat").cast("double")
    up = metres / EARTH_M * 180 / math.pi + 1e-9
    bands = F.sequence(F.greatest(F.floor((lat + 90 - up) / size), F.lit(0)), F.greatest(F.floor((lat + 90 + up) / size), F.lit(0)))
    asked = left.filter("lng is not null and lat is not null").withColumn("band", F.explode(bands)).withColumn("n", columns_of(F.col("band"), size))
    # The widest difference in longitude of two points at this distance, both as far from the equator as the one may be.
    high = off_equator(lat) + up
    top = F.sin(F.lit(metres / (2 * EARTH_M))) / F.cos(F.radians(F.least(high, F.lit(90.0))))
    wide = F.when((high >= 90) | (lat - up < -90) | (top >= 1), F.lit(180.0)).otherwise(2 * F.degrees(F.asin(F.least(top, F.lit(1.0)))) + 1e-9)
    first, last = F.floor((lng - wide) * F.col("n") / 360), F.floor((lng + wide) * F.col("n") / 360)
    asked = asked.withColumn("at", F.explode(F.sequence(first, F.least(last, first + F.col("n") - 1))))
    return asked.withColumn("cell", cell_id(F.col("band"), F.pmod(F.col("at"), F.col("n")))).drop("band", "n", "at")


def holding_cells(right: DataFrame, size: float = SNAP_CELL) -> DataFrame:
    """right's rows with the one cell that their (other_lng, other_lat) is in."""
    other = F.pmod(F.col("other_lng").cast("double") + 180, F.lit(360.0))
    held = right.withColumn("band", F.greatest(F.floor((F.col("other_lat").cast("double") + 90) / size), F.lit(0))).withColumn("n", columns_of(F.col("band"), size))
    return held.withColumn("cell", cell_id(F.col("band"), F.pmod(F.floor(other * F.col("n") / 360), F.col("n")))).drop("band", "n")


def near_points(left: DataFrame, right: DataFrame, metres: float, size: float = SNAP_CELL, *same: str) -> DataFrame:
    """JOIN-8 without its limit: pairs within metres, as dist, of (lng, lat) and (other_lng, other_lat), alike in the columns same."""
    dist = haversine("lng", "lat", "other_lng", "other_lat")
    met = asking_cells(left, metres, size).join(holding_cells(right, size), ["cell", *same])
    return met.drop("cell").withColumn("dist", dist).filter(F.col("dist") <= metres)


def nearest(pairs: DataFrame, key: str, k: int, *ties) -> DataFrame:
    """WIN-2: the k nearest of each key, as rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("dist", *ties))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
