"""Searches, spatial joins, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import search
from cairn.operators.lines import vertex_pairs
from cairn.operators.spatial import lines_in_areas, lines_in_boxes, near_points, nearest, points_in_areas, points_in_boxes
from cairn.plans.basics import IN_AREA, hav, meets
from cairn.plans.ingest import PROGRESS, chunk_progress
from cairn.plans.registry import query, table, view

ROWS = """fr AS (SELECT osm_id, name, via_ferrata_scale, sac_scale, source_type FROM v_via_ferrata_attr UNION ALL
SELECT osm_id, name, NULL, sac_scale, 'name:ferrata' FROM v_trails_attr WHERE name ILIKE '%ferrata%' AND sac_scale IN ('demanding_mountain_hiking', 'alpine_hiking', 'demanding_alpine_hiking', 'difficult_alpine_hiking') AND osm_id NOT IN (SELECT osm_id FROM v_via_ferrata_attr)),
fv AS (SELECT a.osm_id, v.pos, v.lng, v.lat FROM v_via_ferrata_vertices v JOIN v_via_ferrata_attr a USING (id) UNION ALL SELECT osm_id, pos, lng, lat FROM v_trail_vertices WHERE osm_id NOT IN (SELECT osm_id FROM v_via_ferrata_attr)),
fs AS (SELECT osm_id, lng, lat, lead(lng) OVER (PARTITION BY osm_id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY osm_id ORDER BY pos) AS by_ FROM fv),
fl AS (SELECT osm_id, lng, lat, coalesce(bx, lng) AS bx, coalesce(by_, lat) AS by_, coalesce(sqrt(pow(bx - lng, 2) + pow(by_ - lat, 2)), 0) AS len FROM fs)"""
MATCHES = f"""{ROWS},
fm AS (SELECT name, min(osm_id) AS osm_id, min(via_ferrata_scale) AS via_ferrata_scale, min(sac_scale) AS sac_scale, CASE WHEN bool_or(source_type <> 'name:ferrata') THEN 'via_ferrata' ELSE 'trail' END AS source_type FROM fr WHERE name IS NOT NULL GROUP BY name),
fc AS (SELECT name, coalesce(sum(len * (lng + bx) / 2) / nullif(sum(len), 0), avg(lng)) AS lng, coalesce(sum(len * (lat + by_) / 2) / nullif(sum(len), 0), avg(lat)) AS lat FROM fl JOIN fr USING (osm_id) WHERE name IS NOT NULL GROUP BY name),
cand AS (SELECT osm_id, type, name, CAST(elevation AS DOUBLE) AS elevation, lng, lat, NULL AS via_ferrata_scale, NULL AS sac_scale, NULL AS source_type FROM v_pois UNION ALL SELECT osm_id, 'ferrata', name, NULL, lng, lat, via_ferrata_scale, sac_scale, source_type FROM fm JOIN fc USING (name))"""


def ferrata_vertices(spark, d):
    own = view(spark, d, "v_via_ferrata_vertices").join(view(spark, d, "v_via_ferrata_attr").select("id", "osm_id"), "id").select("osm_id", "pos", "lng", "lat")
    others = view(spark, d, "v_trail_vertices").join(view(spark, d, "v_via_ferrata_attr").select("osm_id"), "osm_id", "left_anti")
    return own.unionByName(others.select("osm_id", "pos", "lng", "lat"))


def ferrata_rows(spark, d):
    return search.ferrata_rows(view(spark, d, "v_trails_attr"), view(spark, d, "v_via_ferrata_attr"))


def all_candidates(spark, d):
    return search.candidates(view(spark, d, "v_pois"), search.ferrata_matches(ferrata_rows(spark, d), ferrata_vertices(spark, d)))


@query("JOIN-1", "SELECT osm_id, name FROM v_trails_attr WHERE osm_id NOT IN (SELECT osm_id FROM v_via_ferrata_attr)")
def join_1(spark, d):
    return view(spark, d, "v_trails_attr").join(view(spark, d, "v_via_ferrata_attr"), "osm_id", "left_anti").select("osm_id", "name")


@query("SET-1", f"WITH {ROWS} SELECT osm_id, name, via_ferrata_scale, sac_scale, source_type FROM fr")
def set_1(spark, d):
    return ferrata_rows(spark, d)


@query("AGG-1", f"WITH {MATCHES} SELECT * FROM fm")
def agg_1(spark, d):
    return search.ferrata_matches(ferrata_rows(spark, d), ferrata_vertices(spark, d)).drop("lng", "lat")


@query("SET-2", f"WITH {MATCHES} SELECT osm_id, type, name, elevation, round(lng, 9) AS lng, round(lat, 9) AS lat, via_ferrata_scale, sac_scale, source_type FROM cand")
def set_2(spark, d):
    return all_candidates(spark, d).withColumns({c: F.round(c, 9) for c in ("lng", "lat")})


FILTERS = """asked AS (SELECT r_regionkey AS filter_id, r_regionkey FROM region)"""


def filter_table(spark, d):
    """A few filters as JSON, one of each region's number."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("r_regionkey") + 1).cast("int"))
    return table(spark, d, "region").filter("r_regionkey < 5").select(
        F.col("r_regionkey").cast("long").alias("filter_id"),
        pick(
            '{"types": ["hut", "hut", "castle"], "minElevation": 2000}',
            '{"types": ["peak", "bivouac"], "elevation": {"min": "1500", "max": 3000}, "sort": "elevation_asc", "limit": 999, "offset": -5}',
            '{"types": ["ferrata"], "difficulty": {"viaFerrataScale": {"min": "4"}, "sacScale": ["alpine_hiking", "easy"]}, "sort": "name"}',
            '{"nameContains": " red ", "sort": "height", "limit": "7", "offset": 3, "maxElevation": 0}',
            '{"types": ["hut"], "area": {"kind": "province", "name": "nation_7"}, "minElevation": 900, "maxElevation": 500}',
        ).alias("json"),
    )


def customer_filters(spark, d):
    """What each customer asks for as JSON, with keys that lack, are unknown, out of range or of another type."""
    k = F.col("c_custkey")
    case = lambda n, *xs: F.element_at(F.array(*xs), (k % n + 1).cast("int"))
    words = lambda *xs: F.array(*map(F.lit, xs))
    none = F.lit(None)
    area = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    asked = F.struct(
        case(4, words("hut", "hut", "castle"), words("peak", "bivouac"), words("ferrata"), none).alias("types"),
        F.when(k % 3 == 0, k % 3000 - 10).alias("minElevation"),
        F.when(k % 5 == 0, k * 7 % 3500).alias("maxElevation"),
        F.struct(F.when(k % 2 == 0, (k % 2500).cast("string")).alias("min"), F.when(k % 2 == 0, F.lit(2000)).alias("max")).alias("elevation"),
        case(4, area("province", F.concat(F.lit(" "), "c_mktsegment")), area("region", F.lit(" ")), area("country", F.col("c_mktsegment")), none).alias("area"),
        F.struct(F.struct((k % 6 + 1).cast("string").alias("min")).alias("viaFerrataScale"), F.when(k % 2 == 0, words("alpine_hiking", "easy")).alias("sacScale")).alias("difficulty"),
        F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("nameContains"),
        case(3, F.lit("name"), F.lit("height"), F.lit("elevation_asc")).alias("sort"),
        case(4, F.lit("999"), (k % 40 + 1).cast("string"), none, F.lit("-5")).alias("limit"),
        case(3, F.lit(-5), k, none).alias("offset"),
    )
    return search.filters(table(spark, d, "customer").select(k.alias("filter_id"), F.to_json(asked).alias("json")))


@query("NRM-1", """SELECT c_custkey AS filter_id, CASE c_custkey % 4 WHEN 0 THEN 'hut' WHEN 1 THEN 'peak,bivouac' WHEN 2 THEN 'ferrata' ELSE '' END AS types, chr(CAST(65 + c_custkey % 6 AS INTEGER)) AS grade_min,
CASE WHEN c_custkey % 6 > 0 THEN c_name END AS name_contains, CASE WHEN c_custkey % 2 = 0 THEN 'alpine_hiking' END AS sac_scale, CASE c_custkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'elevation_desc' ELSE 'elevation_asc' END AS sort FROM customer""")
def nrm_1(spark, d):
    return customer_filters(spark, d).select("filter_id", F.array_join("types", ",").alias("types"), "grade_min", "name_contains", F.array_join("sac_scale", ",").alias("sac_scale"), "sort")


@query("NRM-2", """WITH n AS (SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 3000 - 10 WHEN c_custkey % 2 = 0 THEN c_custkey % 2500 END AS DOUBLE) AS low, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 7 % 3500 WHEN c_custkey % 2 = 0 THEN 2000 END AS DOUBLE) AS high FROM customer),
p AS (SELECT k, CASE WHEN low > 0 THEN low END AS low, CASE WHEN high > 0 THEN high END AS high FROM n)
SELECT k AS filter_id, low AS min_elevation, CASE WHEN low IS NULL OR high >= low THEN high END AS max_elevation FROM p""")
def nrm_2(spark, d):
    return customer_filters(spark, d).select("filter_id", "min_elevation", "max_elevation")


@query("NRM-3", "SELECT c_custkey AS filter_id, CASE WHEN c_custkey % 4 = 0 THEN 'province' END AS area_kind, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS area_name FROM customer")
def nrm_3(spark, d):
    return customer_filters(spark, d).select("filter_id", "area_kind", "area_name")


@query("NRM-4", """SELECT c_custkey AS filter_id, CAST(CASE c_custkey % 4 WHEN 1 THEN c_custkey % 40 + 1 WHEN 3 THEN 1 ELSE 50 END AS INTEGER) AS "limit", CAST(CASE WHEN c_custkey % 3 = 1 THEN c_custkey ELSE 0 END AS INTEGER) AS "offset" FROM customer""")
def nrm_4(spark, d):
    return customer_filters(spark, d).select("filter_id", "limit", "offset")


NRM_5 = f"""WITH {MATCHES}, inside AS ({IN_AREA}),
f2 AS (SELECT name, min(osm_id) AS osm_id FROM fr WHERE name IS NOT NULL AND via_ferrata_scale IN ('D', 'E', 'F', '4', '5', '6') AND sac_scale = 'alpine_hiking' GROUP BY name),
hits AS (SELECT 0 AS filter_id, osm_id, name, elevation, -elevation AS k FROM cand WHERE type = 'hut' AND elevation >= 2000
UNION ALL SELECT 1, osm_id, name, elevation, elevation FROM cand WHERE type IN ('peak', 'bivouac') AND elevation BETWEEN 1500 AND 3000
UNION ALL SELECT 2, osm_id, name, NULL, NULL FROM f2
UNION ALL SELECT 3, osm_id, name, elevation, -elevation FROM cand WHERE name ILIKE '%red%'
UNION ALL SELECT 4, p.osm_id, p.name, CAST(p.elevation AS DOUBLE), -CAST(p.elevation AS DOUBLE) FROM v_pois p JOIN inside i ON i.id = p.id JOIN (SELECT DISTINCT area_id, name AS area FROM v_admin_vertices) a ON a.area_id = i.area_id AND lower(a.area) = 'nation_7' WHERE p.type = 'hut' AND p.elevation >= 900),
ranked AS (SELECT filter_id, osm_id, name, elevation, count(*) OVER (PARTITION BY filter_id) AS total, row_number() OVER (PARTITION BY filter_id ORDER BY k NULLS LAST, name NULLS LAST, osm_id) AS rank FROM hits WHERE filter_id IN (SELECT r_regionkey FROM region))
SELECT CAST(filter_id AS BIGINT) AS filter_id, osm_id, name, elevation, total, CAST(rank AS INTEGER) AS rank FROM ranked WHERE CASE filter_id WHEN 3 THEN rank > 3 AND rank <= 10 ELSE rank <= 50 END"""


@query("NRM-5", NRM_5)
def nrm_5(spark, d):
    areas = view(spark, d, "v_admin_vertices")
    found = search.run_filters(search.filters(filter_table(spark, d)), view(spark, d, "v_pois"), ferrata_rows(spark, d), ferrata_vertices(spark, d), areas)
    return found.select("filter_id", "osm_id", "name", "elevation", "total", "rank")


@query("WIN-9", f"""WITH {MATCHES}, q AS (SELECT n_nationkey AS query_id, lower(substring('redbluesmallrodferramonteringboltgear', CAST(n_nationkey + 1 AS INTEGER), 4)) AS q FROM nation),
hit AS (SELECT query_id, osm_id, name, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(name) = q THEN 0 WHEN starts_with(lower(name), q) THEN 1 ELSE 2 END, name, osm_id) AS rank FROM q JOIN cand ON contains(lower(name), q) WHERE length(q) >= 2)
SELECT query_id, osm_id, name, CAST(rank AS INTEGER) AS rank FROM hit WHERE rank <= 20""")
def win_9(spark, d):
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr("lower(substring('redbluesmallrodferramonteringboltgear', n_nationkey + 1, 4))").alias("q"))
    return search.autocomplete(q, all_candidates(spark, d).select("osm_id", "name")).select("query_id", "osm_id", "name", "rank")


@query("SRT-5", "SELECT osm_id, name FROM v_pois WHERE name ILIKE '%rod%' ORDER BY CASE WHEN name ILIKE 'rod' THEN 0 WHEN name ILIKE 'rod%' THEN 1 ELSE 2 END, name, osm_id LIMIT 20")
def srt_5(spark, d):
    relevance = F.when(F.col("name").ilike("rod"), 0).when(F.col("name").ilike("rod%"), 1).otherwise(2)
    return view(spark, d, "v_pois").filter(F.col("name").ilike("%rod%")).orderBy(relevance, "name", "osm_id").limit(20).select("osm_id", "name")


for _id, _sort, _sql in (("SRT-1", "elevation_desc", "elevation DESC NULLS LAST, "), ("SRT-2", "elevation_asc", "elevation ASC NULLS LAST, "), ("SRT-3", "name", "")):

    @query(_id, f"SELECT osm_id, name, elevation FROM v_pois ORDER BY {_sql}name NULLS LAST, osm_id LIMIT 50")
    def _sorted(spark, d, sort=_sort):
        return view(spark, d, "v_pois").orderBy(*search.order_key(sort)).limit(50).select("osm_id", "name", "elevation")


@query("SRT-4", "SELECT osm_id, name, elevation FROM v_pois WHERE type = 'hut' ORDER BY elevation DESC NULLS LAST, name NULLS LAST, osm_id LIMIT 50 OFFSET 50")
def srt_4(spark, d):
    return view(spark, d, "v_pois").filter("type = 'hut'").orderBy(*search.order_key("elevation_desc")).offset(50).limit(50).select("osm_id", "name", "elevation")


@query("SRT-8", "SELECT request_id, minx FROM v_bbox_requests ORDER BY request_id DESC")
def srt_8(spark, d):
    return view(spark, d, "v_bbox_requests").orderBy(F.desc("request_id")).select("request_id", "minx")


HUTS = "SELECT osm_id, name, elevation, count(*) OVER () AS total FROM v_pois WHERE type = 'hut' AND elevation >= 2000 ORDER BY elevation DESC, name NULLS LAST, osm_id LIMIT 50"


@query("WIN-1", HUTS)
def win_1(spark, d):
    """Huts above 2000 m, highest first, first page, with the total."""
    found = view(spark, d, "v_pois").filter("type = 'hut' and elevation >= 2000")
    total = found.agg(F.count("*").alias("total"))
    return found.join(F.broadcast(total)).orderBy(*search.order_key("elevation_desc")).limit(50).select("osm_id", "name", "elevation", "total")


@query("JOIN-2", f"SELECT id, name FROM ({IN_AREA}) i JOIN (SELECT DISTINCT area_id, kind, name FROM v_admin_vertices) a USING (area_id) WHERE kind = 'province' AND lower(name) IN ('nation_3', 'nation_12', 'nowhere')")
def join_2(spark, d):
    asked = spark.createDataFrame([("province", "nation_3"), ("province", "nation_12"), ("province", "nowhere")], "kind string, low string")
    areas = view(spark, d, "v_admin_vertices").withColumn("low", F.lower("name")).join(F.broadcast(asked), ["kind", "low"], "left_semi")
    return points_in_areas(view(spark, d, "v_pois").select("id", "lng", "lat"), areas, ["area_id", "name"]).select("id", "name")


@query("JOIN-5", IN_AREA)
def join_5(spark, d):
    return points_in_areas(view(spark, d, "v_pois").select("id", "lng", "lat"), view(spark, d, "v_admin_vertices"), ["area_id"]).select("id", "area_id")


@query("JOIN-6", "SELECT request_id, id FROM v_bbox_requests JOIN v_pois ON lng BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy")
def join_6(spark, d):
    return points_in_boxes(view(spark, d, "v_pois"), view(spark, d, "v_bbox_requests")).select("request_id", "id")


@query("SET-8", f"""SELECT request_id, 'pois' AS layer, osm_id FROM v_bbox_requests JOIN v_pois ON lng BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy WHERE maxx - minx <= 0.5
UNION ALL SELECT DISTINCT request_id, 'trails', osm_id FROM v_bbox_requests JOIN v_segments ON {meets('minx', 'miny', 'maxx', 'maxy')} WHERE maxx - minx <= 0.5
UNION ALL SELECT DISTINCT request_id, 'via_ferrata', a.osm_id FROM v_bbox_requests JOIN v_ferrata_segments s ON {meets('minx', 'miny', 'maxx', 'maxy')} JOIN v_via_ferrata_attr a ON a.id = s.id WHERE maxx - minx <= 0.5""")
def set_8(spark, d):
    boxes = view(spark, d, "v_bbox_requests").filter("maxx - minx <= 0.5 and maxy - miny <= 0.5")
    pois = points_in_boxes(view(spark, d, "v_pois"), boxes).select("request_id", F.lit("pois").alias("layer"), "osm_id")
    trails = lines_in_boxes(view(spark, d, "v_trail_vertices"), "osm_id", boxes, "request_id").select("request_id", F.lit("trails").alias("layer"), "osm_id")
    own = view(spark, d, "v_via_ferrata_vertices").join(view(spark, d, "v_via_ferrata_attr").select("id", "osm_id"), "id")
    ferrate = lines_in_boxes(own, "osm_id", boxes, "request_id").select("request_id", F.lit("via_ferrata").alias("layer"), "osm_id")
    return pois.unionByName(trails).unionByName(ferrate)


@query("FLT-7", f"""WITH edges AS (SELECT area_id, lng AS cx, lat AS cy, lead(lng) OVER (PARTITION BY area_id ORDER BY pos) AS dx, lead(lat) OVER (PARTITION BY area_id ORDER BY pos) AS dy FROM v_admin_vertices WHERE name = 'NATION_12'),
crossing AS (SELECT DISTINCT osm_id FROM v_segments JOIN edges ON dx IS NOT NULL AND sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0),
inner_ AS (SELECT osm_id FROM v_trail_vertices JOIN edges ON dx IS NOT NULL GROUP BY osm_id, pos HAVING count_if((cy > lat) <> (dy > lat) AND lng < (dx - cx) * (lat - cy) / (dy - cy) + cx) % 2 = 1)
SELECT osm_id FROM crossing UNION SELECT osm_id FROM inner_""")
def flt_7(spark, d):
    return lines_in_areas(view(spark, d, "v_trail_vertices"), "osm_id", view(spark, d, "v_admin_vertices").filter("name = 'NATION_12'"), "name").select("osm_id")


#: Steps are doubles, as in Spark.
CHUNKS = """box AS (SELECT min(lng) AS x, min(lat) AS y, greatest(ceil((max(lng) - min(lng)) / 5e-2), 1) AS cols, greatest(ceil((max(lat) - min(lat)) / 2e-2), 1) AS rows FROM v_trail_vertices HAVING count(*) > 0),
cell AS (SELECT *, unnest(range(CAST(cols AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(rows AS BIGINT))) AS i FROM box)),
chunks AS (SELECT i * CAST(cols AS BIGINT) + j AS chunk_id, x + j * 5e-2 AS minx, y + i * 2e-2 AS miny, x + (j + 1) * 5e-2 AS maxx, y + (i + 1) * 2e-2 AS maxy FROM cell)"""


def grid(points, dx: float, dy: float):
    """SET-5: chunks of whole steps over the box of all points, numbered row by row; none without points."""
    steps = lambda c, d: F.greatest(F.ceil((F.max(c) - F.min(c)) / F.lit(d)), F.lit(1)).cast("long")
    box = points.agg(F.min("lng").alias("x"), F.min("lat").alias("y"), steps("lng", dx).alias("cols"), steps("lat", dy).alias("rows")).filter("x IS NOT NULL")
    each = box.withColumn("i", F.explode(F.expr("sequence(0L, rows - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, cols - 1)")))
    at = lambda base, k, step: F.col(base) + k * F.lit(step)
    return each.select((F.col("i") * F.col("cols") + F.col("j")).alias("chunk_id"), at("x", F.col("j"), dx).alias("minx"), at("y", F.col("i"), dy).alias("miny"), at("x", F.col("j") + 1, dx).alias("maxx"), at("y", F.col("i") + 1, dy).alias("maxy"))


@query("JOIN-7", f"WITH {CHUNKS} SELECT chunk_id, count(DISTINCT osm_id) AS n FROM chunks LEFT JOIN v_segments ON {meets('minx', 'miny', 'maxx', 'maxy')} GROUP BY chunk_id")
def join_7(spark, d):
    vertices = view(spark, d, "v_trail_vertices")
    chunks = grid(vertices, 0.05, 0.02)
    hits = lines_in_boxes(vertices, "osm_id", chunks, "chunk_id", 0.02)
    return chunks.select("chunk_id").join(hits, "chunk_id", "left").groupBy("chunk_id").agg(F.count("osm_id").alias("n"))


@query("AGG-4", f"WITH {CHUNKS}, c AS (SELECT chunk_id, count(DISTINCT osm_id) AS n FROM chunks LEFT JOIN v_segments ON {meets('minx', 'miny', 'maxx', 'maxy')} GROUP BY chunk_id) SELECT CAST(sum(n) AS BIGINT) AS total, count_if(n = 0)::BIGINT AS empty FROM c")
def agg_4(spark, d):
    return join_7(spark, d).agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 0).alias("empty"))


NEAR = f"near AS (SELECT p.id, v.lng AS olng, v.lat AS olat, {hav('p.lng', 'p.lat', 'v.lng', 'v.lat')} AS dist FROM v_pois p JOIN (SELECT DISTINCT lng, lat FROM v_trail_vertices) v ON abs(p.lng - v.lng) < 0.02 AND abs(p.lat - v.lat) < 0.01)"


@query("JOIN-8", f"WITH {NEAR} SELECT id, olng AS other_lng, olat AS other_lat, round(dist, 5) AS dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, olng, olat) AS rank FROM near WHERE dist <= 500) WHERE rank <= 6")
def join_8(spark, d):
    nodes = view(spark, d, "v_trail_vertices").select(F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat")).distinct()
    pairs = near_points(view(spark, d, "v_pois").select("id", "lng", "lat"), nodes, 500.0)
    return nearest(pairs, "id", 6, "other_lng", "other_lat").select("id", "other_lng", "other_lat", F.round("dist", 5).alias("dist"), "rank")


@query("JOIN-9", f"WITH {NEAR} SELECT id, round(min(dist), 5) AS dist FROM near WHERE dist <= 500 GROUP BY id")
def join_9(spark, d):
    nodes = view(spark, d, "v_trail_vertices").select(F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat")).distinct()
    pairs = near_points(view(spark, d, "v_pois").select("id", "lng", "lat"), nodes, 500.0)
    return pairs.groupBy("id").agg(F.round(F.min("dist"), 5).alias("dist"))


@query("WIN-2", f"WITH {NEAR} SELECT id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, olng, olat) AS rank FROM near WHERE dist <= 300) WHERE rank <= 3 GROUP BY id")
def win_2(spark, d):
    nodes = view(spark, d, "v_trail_vertices").select(F.col("lng").alias("other_lng"), F.col("lat").alias("other_lat")).distinct()
    pairs = near_points(view(spark, d, "v_pois").select("id", "lng", "lat"), nodes, 300.0)
    return nearest(pairs, "id", 3, "other_lng", "other_lat").groupBy("id").agg(F.count("*").alias("n"))


@query("AGG-3", "SELECT request_id, count(id) AS n FROM v_bbox_requests LEFT JOIN v_pois ON lng BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY request_id")
def agg_3(spark, d):
    b = view(spark, d, "v_bbox_requests")
    hits = points_in_boxes(view(spark, d, "v_pois"), b).groupBy("request_id").agg(F.count("*").alias("n"))
    return b.select("request_id").join(hits, "request_id", "left").select("request_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SET-3", "SELECT osm_id, ax, ay, bx, by_ FROM v_segments UNION SELECT a.osm_id, s.ax, s.ay, s.bx, s.by_ FROM v_ferrata_segments s JOIN v_via_ferrata_attr a ON a.id = s.id")
def set_3(spark, d):
    own = view(spark, d, "v_via_ferrata_vertices").join(view(spark, d, "v_via_ferrata_attr").select("id", "osm_id"), "id")
    each = vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").unionByName(vertex_pairs(own, "osm_id"))
    return each.drop("pos").distinct().withColumnRenamed("by", "by_")


@query("SET-4", "SELECT user_id, count(DISTINCT event_type) AS n, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id")
def set_4(spark, d):
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]))
    return table(spark, d, "events").groupBy("user_id").agg(seen.alias("s")).select("user_id", F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first"))


@query("SET-5", f"WITH {CHUNKS} SELECT chunk_id, printf('%.3f,%.3f,%.3f,%.3f', miny, minx, maxy, maxx) AS chunk_key FROM chunks")
def set_5(spark, d):
    key = F.format_string("%.3f,%.3f,%.3f,%.3f", "miny", "minx", "maxy", "maxx")
    return grid(view(spark, d, "v_trail_vertices"), 0.05, 0.02).select("chunk_id", key.alias("chunk_key"))


@query("SET-6", "SELECT request_id, CAST(q AS INTEGER) AS q, round(minx + (maxx - minx) / 2 * (q % 2), 9) AS minx, round(miny + (maxy - miny) / 2 * (q // 2), 9) AS miny FROM v_bbox_requests CROSS JOIN (SELECT unnest(range(4)) AS q)")
def set_6(spark, d):
    mx, my = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    quarter = lambda x, y: F.struct(F.lit(x) if isinstance(x, float) else x.alias("x"), y.alias("y"))
    four = F.array(quarter(F.col("minx"), F.col("miny")), quarter(mx, F.col("miny")), quarter(F.col("minx"), my), quarter(mx, my))
    return view(spark, d, "v_bbox_requests").select("request_id", F.posexplode(four).alias("q", "c")).select("request_id", "q", F.round("c.x", 9).alias("minx"), F.round("c.y", 9).alias("miny"))


@query("SET-7", f"WITH {CHUNKS}, {PROGRESS} SELECT chunk_id, printf('%.3f,%.3f', miny, minx) AS chunk_key FROM chunks WHERE chunk_id IN (SELECT chunk FROM cp WHERE status = 'failed')")
def set_7(spark, d):
    failed = chunk_progress(spark, d).filter("status = 'failed'").select(F.col("chunk").alias("chunk_id"))
    chunks = grid(view(spark, d, "v_trail_vertices"), 0.05, 0.02)
    return chunks.join(failed, "chunk_id", "left_semi").select("chunk_id", F.format_string("%.3f,%.3f", "miny", "minx").alias("chunk_key"))


@query("WIN-3", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def win_3(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("WIN-4", "SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id) AS r FROM events) WHERE r <= 3")
def win_4(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.coalesce("value", F.lit(0.0))), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", r.alias("rank")).filter("rank <= 3")


@query("WIN-5", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 5")
def win_5(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return table(spark, d, "events").withColumn("r", r).filter("r <= 5").select("user_id", "event_id")
