"""Landed map data: point collections, map elements, snapshots, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import leading_int

FEATURES = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<id:bigint,osm_id:bigint,name:string,type:string,elevation:string>>>"
ELEMENTS = """elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,nodes:array<bigint>,
members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>"""
SNAPSHOT = """exportedAt string, via_ferrata array<struct<osm_id:bigint,name:string,via_ferrata_scale:string,sac_scale:string,source_type:string>>,
via_ferrata_import_chunks array<struct<chunk_key:string,chunk_index:int,status:string,attempts:int,last_error:string>>"""
AREAS = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_poi_geojson(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC-1: osm_id (the id where absent), type, name (blank: null), elevation (0 or no number: null), lng, lat."""
    f = spark.read.schema(FEATURES).json(path, multiLine=multiline).select(F.explode("features").alias("f")).select("f.*")
    p = F.col("properties")
    return f.select(
        F.coalesce(p["osm_id"], p["id"]).alias("osm_id"), p["type"].alias("type"), F.nullif(p["name"], F.lit("")).alias("name"),
        leading_int(p["elevation"]).alias("elevation"), F.col("geometry.coordinates")[0].alias("lng"), F.col("geometry.coordinates")[1].alias("lat"),
    )


def read_osm_elements(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-2: nodes, ways and relations of landed payloads, in order of their place as seq."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=multiline).select(F.posexplode("elements").alias("seq", "e")).select("seq", "e.*")
    nodes = e.filter("type = 'node'").select("id", "lat", "lon", "tags")
    ways = e.filter("type = 'way'").select("seq", "id", "nodes", "tags", "center")
    return nodes, ways, e.filter("type = 'relation'").select("seq", "id", "members", "tags")


def read_ferrata_snapshot(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC-3: routes and chunks of a snapshot; one without either list is refused when it is read."""
    s = spark.read.schema(SNAPSHOT).json(path, multiLine=multiline)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"snapshot without {c}"))).otherwise(F.col(c))
    return tuple(s.select(F.explode(need(c)).alias("r")).select("r.*") for c in ("via_ferrata", "via_ferrata_import_chunks"))


def read_admin_areas(spark: SparkSession, path: str, kind: str, multiline: bool = True) -> DataFrame:
    """SRC-4: kind, name and polygons (polygon, ring, vertex) of areas that have a shape and a name."""
    f = spark.read.schema(AREAS).json(path, multiLine=multiline).select(F.explode("features").alias("f")).select("f.*")
    text = lambda k: F.nullif(F.trim(F.col("properties")[k]), F.lit(""))
    own = "reg_name" if kind == "region" else "prov_name"
    many = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    raw = F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(one)
    point = lambda v: F.struct(v[0].alias("lng"), v[1].alias("lat"))
    shaped = F.transform(raw, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return f.filter("geometry.coordinates is not null").select(F.lit(kind).alias("kind"), F.coalesce(text(own), text("name")).alias("name"), shaped.alias("polygons")).filter("name is not null")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-3 and FLT-18: (way columns, line) of the ways with two or more nodes that are all known."""
    each = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    found = each.join(nodes.select(F.col("id").alias("node"), F.col("lon").alias("lng"), "lat"), "node")
    points = F.array_sort(F.collect_list(F.struct("pos", "lng", "lat")))
    line = found.groupBy("id").agg(F.transform(points, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))).alias("line"))
    return ways.join(line, "id").filter((F.size("line") == F.size("nodes")) & (F.size("line") >= 2))


def explicit_ferrata(tags) -> F.Column:
    """FLT-17: tags that name a protected route."""
    t = F.col(tags)
    some = (t["highway"] == "via_ferrata") | t["via_ferrata_scale"].isNotNull() | (t["sport"] == "via_ferrata") | (t["route"] == "via_ferrata")
    return F.coalesce(some, F.lit(False))


def source_type(tags, in_relation) -> F.Column:
    """FLT-17: where it is said, the first that holds."""
    t = F.col(tags)
    return (
        F.when(t["highway"] == "via_ferrata", "highway=via_ferrata").when(t["via_ferrata_scale"].isNotNull(), "via_ferrata_scale")
        .when(t["sport"] == "via_ferrata", "sport=via_ferrata").when(t["route"] == "via_ferrata", "route=via_ferrata")
        .when(in_relation, "relation:route=via_ferrata").otherwise("unknown")
    )


def with_relations(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """JOIN-4: ways with relation_ids (all) and the tags of the first relation that names them."""
    members = relations.filter(F.col("tags")["route"] == "via_ferrata").select(F.col("id").alias("relation_id"), "seq", F.col("tags").alias("rel_tags"), F.explode("members").alias("m")).filter("m.type = 'way'")
    by_way = members.groupBy(F.col("m.ref").alias("id")).agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"), F.min_by("rel_tags", F.struct("seq", "relation_id")).alias("rel_tags"))
    return ways.join(by_way, "id", "left")


def trail_admitted(tags) -> F.Column:
    """FLT-15: paths, graded footways, and tracks of grade 1 to 4 or none."""
    t = F.col(tags)
    kind = t["tracktype"]
    track = (t["highway"] == "track") & (kind.isNull() | kind.rlike("^(grade[1-4]|)$"))
    return F.coalesce((t["highway"] == "path") | ((t["highway"] == "footway") & t["sac_scale"].isNotNull()) | track, F.lit(False))


def trail_scale(tags) -> F.Column:
    """FLT-16: the grade, 'track' for a track, else 'unknown'."""
    t = F.col(tags)
    return F.coalesce(t["sac_scale"], F.when(t["highway"] == "track", "track"), F.lit("unknown"))


def poi_rows(elements: DataFrame) -> DataFrame:
    """FLT-14: type, name, elevation, website of elements (id, lat, lon, tags); unnamed peaks and those without a place go."""
    t = F.col("tags")
    kind = F.when(t["tourism"] == "alpine_hut", "hut").when(t["tourism"] == "wilderness_hut", "bivouac").when(t["natural"] == "peak", "peak").otherwise("unknown")
    text = lambda k: F.nullif(t[k], F.lit(""))
    rows = elements.withColumn("type", kind).filter("(type <> 'peak' or nullif(tags['name'], '') is not null) and lat is not null and lon is not null and lat <> 0 and lon <> 0")
    return rows.select(
        F.col("id").alias("osm_id"), "type", F.coalesce(text("name"), F.concat(F.lit("Unknown ("), F.col("type"), F.lit(")"))).alias("name"), leading_int(t["ele"]).alias("elevation"),
        F.coalesce(text("website"), text("contact:website"), F.lit("")).alias("website"), F.col("lon").alias("lng"), F.col("lat").alias("lat"),
    )


def first_of_each(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
