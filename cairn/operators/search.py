"""Structured search: a table of filters run against points of interest and protected routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import grade, grade_tokens
from cairn.operators.lines import centroids
from cairn.operators.spatial import points_in_areas

# What can be searched for, sorted by, and named as an area.
TYPES = ["peak", "hut", "bivouac", "ferrata"]
SORTS = ["elevation_desc", "elevation_asc", "name"]
AREA_KINDS = ["province", "region", "viewport", "bbox"]
SAC_SCALES = ["hiking", "mountain_hiking", "demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
FERRATA_SAC = ["demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]
LIMIT, MAX_TEXT = 50, 100

RAW = """types array<string>, minElevation string, maxElevation string, elevation struct<min:string,max:string>,
area struct<kind:string,name:string,bbox:array<double>>, difficulty struct<viaFerrataScale:struct<min:string,max:string>,sacScale:array<string>>,
nameContains string, sort string, limit string, offset string"""


def json_in(text) -> F.Column:
    """TXT-9: from the first opening to the last closing brace; null without both."""
    start, length = F.instr(text, "{"), F.length(text)
    end = length - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (F.instr(F.reverse(text), "}") > 0) & (end > start), F.substring(text, start, end - start + 1))


def filters(raw: DataFrame, json: str = "json") -> DataFrame:
    """NRM-1 to NRM-4: raw's other columns and safe columns for what its JSON asks for.

    Only known types, kinds, scales and sorts pass; texts are trimmed and cut at 100 signs.
    Bounds of elevation are positive and in order, new keys going before the old ones.  A
    province or region needs a name.  limit is 1 to 50 (50 if absent or null), offset 0 or more.
    """
    one = raw.withColumn("_keys", F.json_object_keys(json)).withColumn("_f", F.from_json(json, RAW))
    f = F.col("_f")
    text = lambda c: F.when(F.trim(c) != "", F.substring(F.trim(c), 1, MAX_TEXT))
    number = lambda c: F.trim(c).try_cast("double")
    has = lambda k: F.coalesce(F.array_contains("_keys", k), F.lit(False))
    positive = lambda c: F.when(c > 0, c)
    low = positive(F.when(has("minElevation"), number(f["minElevation"])).otherwise(number(f["elevation"]["min"])))
    high = positive(F.when(has("maxElevation"), number(f["maxElevation"])).otherwise(number(f["elevation"]["max"])))
    kind = F.when(f["area"]["kind"].isin(AREA_KINDS), f["area"]["kind"])
    name = text(f["area"]["name"])
    place = kind.isin("viewport", "bbox") | name.isNotNull()
    known = lambda c, words: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isin(words))
    sac = known(f["difficulty"]["sacScale"], SAC_SCALES)
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    out = one.withColumns({
        "types": F.array_distinct(known(f["types"], TYPES)),
        "min_elevation": low,
        "max_elevation": F.when(low.isNull() | (high >= low), high),
        "area_kind": F.when(place, kind),
        "area_name": F.when(kind.isin("province", "region"), name),
        "bbox": F.when(kind.isin("viewport", "bbox") & (F.size(f["area"]["bbox"]) == 4), f["area"]["bbox"]),
        "grade_min": grade(f["difficulty"]["viaFerrataScale"]["min"]),
        "grade_max": grade(f["difficulty"]["viaFerrataScale"]["max"]),
        "sac_scale": F.when(F.size(sac) > 0, sac),
        "name_contains": text(f["nameContains"]),
        "sort": F.when(f["sort"].isin(SORTS), f["sort"]).otherwise("elevation_desc"),
        "limit": F.coalesce(F.greatest(F.least(whole(number(f["limit"])), F.lit(LIMIT)), F.lit(1)), F.lit(LIMIT)).cast("int"),
        "offset": F.coalesce(F.greatest(whole(number(f["offset"])), F.lit(0)), F.lit(0)).cast("int"),
    })
    return out.drop("_keys", "_f")


def ferrata_rows(trails: DataFrame, via_ferrata: DataFrame) -> DataFrame:
    """SET-1: protected routes, and the trails that are named and graded like one and not among them.

    JOIN-1 is the anti-join.  Columns are osm_id, name, via_ferrata_scale, sac_scale, source_type.
    """
    named = trails.filter(F.col("name").ilike("%ferrata%") & F.col("sac_scale").isin(FERRATA_SAC))
    extra = named.join(via_ferrata.select("osm_id"), "osm_id", "left_anti").select("osm_id", "name", "sac_scale", F.lit("name:ferrata").alias("source_type"))
    return via_ferrata.select("osm_id", "name", "via_ferrata_scale", "sac_scale", "source_type").unionByName(extra, allowMissingColumns=True)


def ferrata_matches(rows: DataFrame, vertices: DataFrame, group: list[str] | None = None) -> DataFrame:
    """AGG-1 and AGG-2: one row of each name, with least values and the centroid of all its lines.

    vertices has osm_id, pos, lng, lat of the same routes; group has further grouping columns.
    """
    keys = [*(group or []), "name"]
    named = rows.filter("name is not null")
    own = F.when(F.bool_or(F.col("source_type") != "name:ferrata"), "via_ferrata").otherwise("trail")
    told = named.groupBy(*keys).agg(F.min("osm_id").alias("osm_id"), F.min("via_ferrata_scale").alias("via_ferrata_scale"), F.min("sac_scale").alias("sac_scale"), own.alias("source_type"))
    at = vertices.join(named.select("osm_id", *keys), "osm_id").withColumn("line", F.struct("osm_id", *(group or [])))
    return told.join(centroids(at, "line", keys), keys)


def candidates(pois: DataFrame, ferrate: DataFrame) -> DataFrame:
    """SET-2: both as result rows."""
    nothing = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    p = pois.select("osm_id", "type", "name", F.col("elevation").cast("double").alias("elevation"), F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat"), *nothing("via_ferrata_scale", "sac_scale", "source_type"))
    f = ferrate.select("osm_id", F.lit("ferrata").alias("type"), "name", F.lit(None).cast("double").alias("elevation"), "lng", "lat", "via_ferrata_scale", "sac_scale", "source_type")
    return p.unionByName(f)


def order_key(sort: str):
    """SRT-1 to SRT-3: the order of a sort, absent values last, ids breaking ties."""
    by = {"elevation_desc": [F.desc_nulls_last("elevation")], "elevation_asc": [F.asc_nulls_last("elevation")], "name": []}[sort]
    return [*by, F.asc_nulls_last("name"), F.asc("osm_id")]


def run_filters(asked: DataFrame, pois: DataFrame, rows: DataFrame, vertices: DataFrame, areas: DataFrame) -> DataFrame:
    """NRM-5: each filter's page of results: filter_id, rank, total and the result's columns.

    asked comes from filters() and has filter_id.  A filter without types asks for all.
    Protected routes are filtered before they are grouped by name, so each filter groups its
    own.  JOIN-2: an area that does not exist gives no rows.  A filter meets only the rows of
    its types, by an equi-join.
    """
    wanted = asked.withColumn("type", F.explode(F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(*map(F.lit, TYPES)))))
    spot = pois.select("osm_id", F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat"))
    mid = vertices.groupBy("osm_id").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    inside = points_in_areas(spot.unionByName(mid), areas, ["kind", "name"]).groupBy("osm_id").agg(F.collect_set(F.struct("kind", F.lower("name").alias("name"))).alias("areas"))
    place = F.struct(F.col("area_kind").alias("kind"), F.lower("area_name").alias("name"))
    here = F.col("area_name").isNull() | F.array_contains("areas", place)
    named = F.col("name_contains").isNull() | F.ilike("name", F.concat(F.lit("%"), F.col("name_contains"), F.lit("%")))
    high = (F.col("min_elevation").isNull() | (F.col("elevation") >= F.col("min_elevation"))) & (F.col("max_elevation").isNull() | (F.col("elevation") <= F.col("max_elevation")))
    of_type = wanted.filter("type <> 'ferrata'").join(pois.withColumn("elevation", F.col("elevation").cast("double")), "type").join(inside, "osm_id", "left").filter(named & high & here)
    graded = F.col("grade_min").isNull() & F.col("grade_max").isNull()
    scale = graded | F.coalesce(F.array_contains(grade_tokens("grade_min", "grade_max"), F.col("via_ferrata_scale")), F.lit(False))
    scaled = F.col("sac_scale_asked").isNull() | F.coalesce(F.array_contains("sac_scale_asked", F.col("sac_scale")), F.lit(False))
    no_height = F.col("min_elevation").isNull() & F.col("max_elevation").isNull()
    routes = wanted.filter("type = 'ferrata'").filter(no_height).withColumnRenamed("sac_scale", "sac_scale_asked").join(rows.withColumn("type", F.lit("ferrata")), "type").join(inside, "osm_id", "left").filter(named & scale & scaled & here)
    ferrate = ferrata_matches(routes.select("filter_id", *rows.columns), vertices, ["filter_id"])
    found = of_type.select("filter_id", "osm_id", "type", "name", "elevation", F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat")).unionByName(ferrate.withColumn("type", F.lit("ferrata")), allowMissingColumns=True)
    found = found.join(asked.select("filter_id", "sort", "limit", "offset"), "filter_id")
    height = F.when(F.col("sort") == "elevation_desc", -F.col("elevation")).when(F.col("sort") == "elevation_asc", F.col("elevation"))
    mine = Window.partitionBy("filter_id")
    ranked = found.withColumns({"total": F.count("*").over(mine), "rank": F.row_number().over(mine.orderBy(height.asc_nulls_last(), F.asc_nulls_last("name"), "osm_id"))})
    return ranked.filter((F.col("rank") > F.col("offset")) & (F.col("rank") <= F.col("offset") + F.col("limit"))).drop("sort", "limit", "offset")


def autocomplete(asked: DataFrame, found: DataFrame, k: int = 20) -> DataFrame:
    """WIN-9 and SRT-5: per (query_id, q) the first k names that contain q: equal, then beginning, then others, by name.

    Names are met by their words of three letters, an equi-join, with the exact test behind it;
    shorter queries (from two letters, FLT-26) by those of two.
    """
    shingles = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    low = F.lower("q")
    q = asked.filter(F.length("q") >= 2).withColumn("shingle", F.substring(low, 1, 3))
    names = found.filter("name is not null").withColumn("shingle", F.explode(F.array_union(shingles(F.lower("name"), 3), shingles(F.lower("name"), 2))))
    hit = q.join(names, "shingle").filter(F.contains(F.lower("name"), low)).drop("shingle")
    relevance = F.when(F.lower("name") == low, 0).when(F.startswith(F.lower("name"), low), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(relevance, F.asc_nulls_last("name"), "osm_id"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= k)
