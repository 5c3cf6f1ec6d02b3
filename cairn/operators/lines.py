"""Lines from vertices, and what is computed over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geo import cell, cell_id, haversine


def lines(vertices: DataFrame, key: str) -> DataFrame:
    """JOIN-3's ordered collect: (key, line) with the vertices of a key in order of pos."""
    points = F.array_sort(F.collect_list(F.struct("pos", "lng", "lat")))
    return vertices.groupBy(key).agg(F.transform(points, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"))


def rings(vertices: DataFrame, key: list[str]) -> DataFrame:
    """(key, rings) from rows of key, ring, pos, lng, lat."""
    ring = lines(vertices.withColumn("of", F.struct(*key, "ring")), "of")
    return ring.select("of.*", "line").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "line"))), lambda r: r["line"]).alias("rings"))


def vertex_pairs(vertices: DataFrame, key: str) -> DataFrame:
    """WIN-7 and TGF-3 over rows: each vertex with the next one of its key as ax, ay, bx, by."""
    over = Window.partitionBy(key).orderBy("pos")
    return vertices.select(key, "pos", F.col("lng").alias("ax"), F.col("lat").alias("ay"), F.lead("lng").over(over).alias("bx"), F.lead("lat").over(over).alias("by")).filter("bx is not null and by is not null")


def boxes(vertices: DataFrame, key: str) -> DataFrame:
    """Bounding box of each line."""
    return vertices.groupBy(key).agg(F.min("lng").alias("minx"), F.min("lat").alias("miny"), F.max("lng").alias("maxx"), F.max("lat").alias("maxy"))


def centroids(vertices: DataFrame, line_key: str, group: list[str]) -> DataFrame:
    """AGG-2: length-weighted mean of segment middles of a group's lines; without length the mean of the points.

    vertices has the group's columns too.
    """
    over = Window.partitionBy(line_key).orderBy("pos")
    s = vertices.withColumn("bx", F.lead("lng").over(over)).withColumn("by", F.lead("lat").over(over))
    length = F.sqrt(F.pow(F.col("bx") - F.col("lng"), F.lit(2)) + F.pow(F.col("by") - F.col("lat"), F.lit(2)))
    s = s.withColumn("len", F.coalesce(length, F.lit(0.0)))
    weighted = lambda a, b: F.try_divide(F.sum(F.col("len") * (F.col(a) + F.coalesce(F.col(b), F.col(a))) / 2), F.sum("len"))
    return s.groupBy(*group).agg(F.coalesce(weighted("lng", "bx"), F.avg("lng")).alias("lng"), F.coalesce(weighted("lat", "by"), F.avg("lat")).alias("lat"))


def with_cells(df: DataFrame, size: float, minx: str, miny: str, maxx: str, maxy: str, name: str = "cell") -> DataFrame:
    """One row for each grid cell that the box touches, so that theta joins become equi-joins."""
    xs = F.sequence(cell(minx, size), cell(maxx, size))
    ys = F.sequence(cell(miny, size), cell(maxy, size))
    return df.withColumn("cell_x", F.explode(xs)).withColumn(name, F.explode(F.transform(ys, lambda y: cell_id(F.col("cell_x"), y)))).drop("cell_x")


def length_km(vertices: DataFrame, key: str) -> DataFrame:
    """AGG-9: length of each line in kilometres."""
    return vertex_pairs(vertices, key).groupBy(key).agg((F.sum(haversine("ax", "ay", "bx", "by")) / 1000).alias("km"))
