"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geo, text
from cairn.operators.lines import boxes, centroids, length_km, lines, vertex_pairs
from cairn.operators.spatial import points_in_areas
from cairn.plans.registry import query, table, view

HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def hav(a, b, c, d) -> str:
    """SQL for the metres from (a, b) to (c, d), each longitude and latitude."""
    return HAV.format(a=b, b=d, c=a, d=c)


@query("SCL-1", f"SELECT osm_id, pos, round({hav('ax', 'ay', 'bx', 'by_')}, 5) AS metres FROM v_segments")
def scl_1(spark, d):
    return vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").select("osm_id", "pos", F.round(geo.haversine("ax", "ay", "bx", "by"), 5).alias("metres"))


@query("SCL-2", """SELECT osm_id, pos, round((degrees(atan2(sin(radians(bx) - radians(ax)) * cos(radians(by_)), cos(radians(ay)) * sin(radians(by_)) - sin(radians(ay)) * cos(radians(by_)) * cos(radians(bx) - radians(ax)))) + 360) % 360, 6) AS bearing FROM v_segments""")
def scl_2(spark, d):
    return vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").select("osm_id", "pos", F.round(geo.bearing("ax", "ay", "bx", "by"), 6).alias("bearing"))


@query("SCL-3", "SELECT osm_id, pos, round(ax + (bx - ax) * 0.25, 9) AS lng, round(ay + (by_ - ay) * 0.25, 9) AS lat FROM v_segments")
def scl_3(spark, d):
    s = vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id")
    return s.select("osm_id", "pos", F.round(geo.between("ax", "bx", 0.25), 9).alias("lng"), F.round(geo.between("ay", "by", 0.25), 9).alias("lat"))


@query("SCL-4", """SELECT DISTINCT concat(CAST(CAST(floor(lng * 1e5 + 0.5) AS BIGINT) AS STRING), '_', CAST(CAST(floor(lat * 1e5 + 0.5) AS BIGINT) AS STRING)) AS node FROM v_trail_vertices""")
def scl_4(spark, d):
    return view(spark, d, "v_trail_vertices").select(geo.key_text("lng", "lat").alias("node")).distinct()


@query("SCL-5", "SELECT CAST(floor(lng / 0.01) AS BIGINT) AS cx, CAST(floor(lat / 0.01) AS BIGINT) AS cy, count(*) AS n FROM v_trail_vertices GROUP BY 1, 2")
def scl_5(spark, d):
    return view(spark, d, "v_trail_vertices").groupBy(geo.cell("lng", 0.01).alias("cx"), geo.cell("lat", 0.01).alias("cy")).agg(F.count("*").alias("n"))


@query("SCL-6", "SELECT id, round(lng - 300.0 / (111320.0 * cos(radians(lat))), 9) AS minx, round(lat - 300.0 / 111320.0, 9) AS miny, round(lng + 300.0 / (111320.0 * cos(radians(lat))), 9) AS maxx, round(lat + 300.0 / 111320.0, 9) AS maxy FROM v_pois")
def scl_6(spark, d):
    box = geo.around("lng", "lat", 300.0)
    return view(spark, d, "v_pois").select("id", *(F.round(box[c], 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


@query("SCL-7", "SELECT id, CAST(floor((lng + 180) / 360 * pow(2.0, 14)) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2.0, 14)) AS BIGINT) AS y FROM v_pois")
def scl_7(spark, d):
    return view(spark, d, "v_pois").select("id", geo.tile_x("lng", 14).alias("x"), geo.tile_y("lat", 14).alias("y"))


@query("SCL-8", "SELECT osm_id, pos, lng, lat FROM v_trail_vertices WHERE pos % 3 <> 0")
def scl_8(spark, d):
    v = view(spark, d, "v_trail_vertices")
    raw = F.when(F.col("pos") % 3 == 0, F.array("lng")).otherwise(F.array("lng", "lat"))
    return v.select("osm_id", "pos", geo.coordinate(raw).alias("c")).filter("c is not null").select("osm_id", "pos", "c.lng", "c.lat")


@query("SCL-9", "SELECT osm_id, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_lines FROM (SELECT osm_id, count(*) AS n FROM v_trail_vertices GROUP BY osm_id)")
def scl_9(spark, d):
    one = lines(view(spark, d, "v_trail_vertices"), "osm_id")
    kind = F.when(F.size("line") > 1, "LineString").otherwise("Point")
    as_lines = F.when(kind == "LineString", F.array("line")).otherwise(F.slice(F.array("line"), 1, 0))
    return one.select("osm_id", F.size(as_lines).alias("n_lines"))


@query("SCL-10", f"SELECT doc_id, translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}') AS folded FROM documents")
def scl_10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold("text").alias("folded"))


@query("SCL-11", "SELECT id, trim(regexp_replace(replace(replace(lower(name), '.', ''), '''', ''), '\\s+', ' ', 'g')) AS folded FROM v_pois WHERE name IS NOT NULL")
def scl_11(spark, d):
    return view(spark, d, "v_pois").filter("name is not null").select("id", text.fold_name("name").alias("folded"))


SQL_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


@query("SCL-12", f"SELECT place_id, array_to_string({SQL_TOKENS.format('display_name')}, ' ') AS tokens FROM v_places")
def scl_12(spark, d):
    return view(spark, d, "v_places").select("place_id", F.array_join(text.tokens("display_name"), " ").alias("tokens"))


@query("SCL-13", f"SELECT place_id, array_to_string(list_filter({SQL_TOKENS.format('display_name')}, lambda t: t NOT IN ('rifugio','baita','capanna','chalet','casera','bivacco','bivouac','ostello','albergo','hotel','agriturismo','parcheggio')), ' ') AS tokens FROM v_places")
def scl_13(spark, d):
    return view(spark, d, "v_places").select("place_id", F.array_join(text.distinctive("display_name"), " ").alias("tokens"))


@query("SCL-14", """SELECT id, trim(regexp_replace(lower(name), '^(rifugio|bivacco|monte) ', '')) AS core FROM (SELECT id, regexp_replace(name, ' [0-9]$', '') AS name FROM v_pois WHERE name IS NOT NULL)""")
def scl_14(spark, d):
    return view(spark, d, "v_pois").filter("name is not null").select("id", F.array_join(text.core_tokens("name", "type"), " ").alias("core"))


@query("SCL-15", """SELECT place_id, CAST(CASE WHEN k = 0 THEN 1 WHEN k IN (1, 2) THEN 2 END AS INTEGER) AS tier FROM (SELECT place_id, place_id % 10 AS k FROM v_places)""")
def scl_15(spark, d):
    p = view(spark, d, "v_places").join(view(spark, d, "v_pois").select(F.col("id").alias("near_poi"), "name"), "near_poi")
    return p.select("place_id", text.name_tier("name", "display_name").alias("tier"))


@query("SCL-16", "SELECT id, regexp_replace(lower(name), '^(rifugio|bivacco|bivouac)\\s+', '') AS bare FROM v_pois WHERE name IS NOT NULL")
def scl_16(spark, d):
    return view(spark, d, "v_pois").filter("name is not null").select("id", text.strip_kind("name").alias("bare"))


@query("SCL-17", "SELECT place_id, regexp_matches(lower(display_name), '\\bostello\\b') AS found FROM v_places")
def scl_17(spark, d):
    return view(spark, d, "v_places").select("place_id", text.has_word("display_name", F.lit("ostello")).alias("found"))


@query("SCL-18", r"""SELECT doc_id, rtrim(CASE WHEN length(t) <= 60 OR substring(t, 61, 1) = ' ' THEN substring(t, 1, 60) WHEN contains(substring(t, 1, 60), ' ') THEN regexp_extract(substring(t, 1, 60), '(?s)^(.*) ', 1) ELSE substring(t, 1, 60) END, ' ') AS cut FROM (SELECT doc_id, text AS t FROM documents)""")
def scl_18(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_words("text", 60).alias("cut"))


@query("SCL-19", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def scl_19(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("plain"))


@query("SCL-20", "SELECT id, sha256(coalesce(CASE WHEN id % 2 = 0 THEN CAST(osm_id AS STRING) END, lower(trim(name)) || '::' || lower(trim(type)))) AS cache_key FROM v_pois")
def scl_20(spark, d):
    return view(spark, d, "v_pois").select("id", text.cache_key(F.when(F.col("id") % 2 == 0, F.col("osm_id")), "name", "type").alias("cache_key"))


@query("SCL-21", "SELECT place_id, 'https://www.google.com/maps/search/?api=1&query=' || replace(display_name, ' ', '%20') || '&query_place_id=' || CAST(place_id AS STRING) AS url FROM v_places")
def scl_21(spark, d):
    url = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), text.percent("display_name"), F.lit("&query_place_id="), F.col("place_id").cast("string"))
    return view(spark, d, "v_places").select("place_id", url.alias("url"))


@query("SCL-22", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""")
def scl_22(spark, d):
    return table(spark, d, "pages").select("page_id", text.escape("html").alias("escaped"))


@query("SCL-23", "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND regexp_matches(url, '^https?://') THEN url END AS url FROM pages")
def scl_23(spark, d):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp"), F.substring("url", 5, 1000))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.safe_url(raw).alias("url"))


@query("SCL-24", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def scl_24(spark, d):
    return table(spark, d, "events").select("event_id", text.month_label("ts").alias("month"))


@query("SCL-25", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def scl_25(spark, d):
    landed = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "orders").select("o_orderkey", F.year(F.try_to_timestamp(landed)).alias("y"))


@query("SCL-26", "SELECT id, printf('%.5f, %.5f', lat, lng) AS label FROM v_pois")
def scl_26(spark, d):
    return view(spark, d, "v_pois").select("id", F.format_string("%.5f, %.5f", F.col("lat").cast("double"), F.col("lng").cast("double")).alias("label"))


@query("SCL-27", "SELECT id, CASE WHEN via_ferrata_scale BETWEEN '1' AND '6' THEN chr(64 + CAST(via_ferrata_scale AS INTEGER)) ELSE via_ferrata_scale END AS grade FROM (SELECT id, via_ferrata_scale FROM v_via_ferrata_attr WHERE via_ferrata_scale BETWEEN '1' AND '6') UNION ALL SELECT id, via_ferrata_scale FROM v_via_ferrata_attr WHERE via_ferrata_scale IS NULL OR NOT via_ferrata_scale BETWEEN '1' AND '6'")
def scl_27(spark, d):
    return view(spark, d, "v_via_ferrata_attr").select("id", text.grade("via_ferrata_scale").alias("grade"))


@query("SCL-32", rf"SELECT conv_id, turn, trim(regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '\s+', ' ', 'g')) AS k FROM conversations")
def scl_32(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(text.fold("text"), r"\s+", " ")).alias("k"))


@query("SCL-33", "SELECT osm_id, upper(substring(sac_scale, 1, 1)) || replace(substring(sac_scale, 2), '_', ' ') AS label FROM v_trails_attr")
def scl_33(spark, d):
    return view(spark, d, "v_trails_attr").select("osm_id", text.capitalised(F.replace("sac_scale", F.lit("_"), F.lit(" "))).alias("label"))


@query("SCL-35", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '([^/]*)/*$', 1), '\.html?$', '') AS slug FROM pages")
def scl_35(spark, d):
    return table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), text.slug("url").alias("slug"))


@query("SCL-37", "SELECT request_id, CAST(5 AS INTEGER) AS n, round(minx + maxx + maxx + minx + minx, 6) AS sx, round(miny + miny + maxy + maxy + miny, 6) AS sy FROM v_bbox_requests")
def scl_37(spark, d):
    ring = geo.ring_of_box("minx", "miny", "maxx", "maxy")
    total = lambda c: F.round(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]), 6)
    return view(spark, d, "v_bbox_requests").select("request_id", F.size(ring).alias("n"), total("lng").alias("sx"), total("lat").alias("sy"))


# ---- filters ----


@query("FLT-1", "SELECT request_id, request_id % 4 NOT IN (1, 2) AS valid FROM v_bbox_requests")
def flt_1(spark, d):
    b = view(spark, d, "v_bbox_requests")
    swapped, broken = F.col("request_id") % 4 == 1, F.col("request_id") % 4 == 2
    raw = b.select("request_id", F.when(broken, "abc").otherwise(F.when(swapped, F.col("maxx")).otherwise(F.col("minx")).cast("string")).alias("a"), F.col("miny").cast("string").alias("b"), F.when(swapped, F.col("minx")).otherwise(F.col("maxx")).cast("string").alias("c"), F.col("maxy").cast("string").alias("e"))
    return raw.select("request_id", geo.valid_bbox("a", "b", "c", "e").alias("valid"))


@query("FLT-2", "SELECT request_id, CASE WHEN maxx - minx > 0.5 OR maxy - miny > 0.5 THEN 'too_large' ELSE 'ok' END AS status FROM v_bbox_requests")
def flt_2(spark, d):
    large = (F.col("maxx") - F.col("minx") > 0.5) | (F.col("maxy") - F.col("miny") > 0.5)
    return view(spark, d, "v_bbox_requests").select("request_id", F.when(large, "too_large").otherwise("ok").alias("status"))


@query("FLT-3", "SELECT id, printf('%.4f,%.4f', lat, lng) AS cache_key FROM v_pois WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180")
def flt_3(spark, d):
    p = view(spark, d, "v_pois").filter("lat between -90 and 90 and lng between -180 and 180")
    return p.select("id", F.format_string("%.4f,%.4f", F.col("lat").cast("double"), F.col("lng").cast("double")).alias("cache_key"))


@query("FLT-4", "SELECT id FROM v_pois WHERE lng BETWEEN 9.0 AND 9.8 AND lat BETWEEN 45.9 AND 46.3")
def flt_4(spark, d):
    return view(spark, d, "v_pois").filter(geo.point_in_box("lng", "lat", 9.0, 45.9, 9.8, 46.3)).select("id")


SIDES = "(bx - ax) * ({y} - ay) - (by_ - ay) * ({x} - ax)"
MEETS = "least(ax, bx) <= {x1} AND greatest(ax, bx) >= {x0} AND least(ay, by_) <= {y1} AND greatest(ay, by_) >= {y0} AND NOT (least({s}) > 0 OR greatest({s}) < 0)"


def meets(x0, y0, x1, y1) -> str:
    sides = ", ".join(SIDES.format(x=x, y=y) for x in (x0, x1) for y in (y0, y1))
    return MEETS.format(x0=x0, y0=y0, x1=x1, y1=y1, s=sides)


@query("FLT-5", f"SELECT DISTINCT osm_id FROM v_segments WHERE {meets(9.0505, 46.0203, 9.0807, 46.0407)}")
def flt_5(spark, d):
    one = lines(view(spark, d, "v_trail_vertices"), "osm_id").filter("size(line) > 1")
    return one.filter(geo.line_meets_box("line", 9.0505, 46.0203, 9.0807, 46.0407)).select("osm_id")


IN_AREA = """SELECT p.id, a.area_id FROM v_pois p JOIN (SELECT area_id, lng AS ax, lat AS ay, lead(lng) OVER (PARTITION BY area_id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY area_id ORDER BY pos) AS by_ FROM v_admin_vertices) a ON a.bx IS NOT NULL
GROUP BY p.id, a.area_id HAVING count_if((ay > p.lat) <> (by_ > p.lat) AND p.lng < (bx - ax) * (p.lat - ay) / (by_ - ay) + ax) % 2 = 1
 OR bool_or((bx - ax) * (p.lat - ay) - (by_ - ay) * (p.lng - ax) = 0 AND p.lng BETWEEN least(ax, bx) AND greatest(ax, bx) AND p.lat BETWEEN least(ay, by_) AND greatest(ay, by_))"""


@query("FLT-6", f"SELECT id FROM ({IN_AREA}) i JOIN (SELECT DISTINCT area_id, name FROM v_admin_vertices) a USING (area_id) WHERE name = 'NATION_7'")
def flt_6(spark, d):
    area = view(spark, d, "v_admin_vertices").filter("name = 'NATION_7'")
    return points_in_areas(view(spark, d, "v_pois").drop("name"), area, ["name"]).select("id")


@query("FLT-8", "SELECT id, type FROM v_pois WHERE type IN ('hut', 'bivouac')")
def flt_8(spark, d):
    return view(spark, d, "v_pois").filter(F.col("type").isin("hut", "bivouac")).select("id", "type")


@query("FLT-9", "SELECT id, elevation FROM v_pois WHERE elevation >= 2000 AND elevation <= 3000")
def flt_9(spark, d):
    return view(spark, d, "v_pois").filter((F.col("elevation") >= 2000) & (F.col("elevation") <= 3000)).select("id", "elevation")


@query("FLT-10", "SELECT id, name FROM v_pois WHERE name ILIKE '%red%'")
def flt_10(spark, d):
    return view(spark, d, "v_pois").filter(F.col("name").ilike("%red%")).select("id", "name")


@query("FLT-11", "SELECT osm_id FROM v_trails_attr WHERE sac_scale IN ('alpine_hiking', 'difficult_alpine_hiking')")
def flt_11(spark, d):
    return view(spark, d, "v_trails_attr").filter(F.col("sac_scale").isin("alpine_hiking", "difficult_alpine_hiking")).select("osm_id")


@query("FLT-12", "SELECT id FROM v_via_ferrata_attr WHERE via_ferrata_scale IN ('D', 'E', 'F', '4', '5', '6')")
def flt_12(spark, d):
    return view(spark, d, "v_via_ferrata_attr").filter(F.array_contains(text.grade_tokens(F.lit("4"), F.lit("F")), F.col("via_ferrata_scale"))).select("id")


# Scales on which a trail named so is a protected route.
FERRATA_SAC = ["demanding_mountain_hiking", "alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking"]


@query("FLT-13", "SELECT osm_id, name FROM v_trails_attr WHERE name ILIKE '%ferrata%' AND sac_scale IN ('demanding_mountain_hiking', 'alpine_hiking', 'demanding_alpine_hiking', 'difficult_alpine_hiking')")
def flt_13(spark, d):
    return view(spark, d, "v_trails_attr").filter(F.col("name").ilike("%ferrata%") & F.col("sac_scale").isin(FERRATA_SAC)).select("osm_id", "name")


@query("FLT-19", "SELECT id, elevation IS NOT NULL AS valid FROM v_pois")
def flt_19(spark, d):
    label = F.coalesce(F.col("elevation").cast("string"), F.lit("N/D"))
    n = label.try_cast("double")
    valid = F.when(n.isNotNull(), (n > 0) & ~F.isnan(n)).otherwise((F.trim(label) != "") & (label != "N/D"))
    return view(spark, d, "v_pois").select("id", valid.alias("valid"))


@query("FLT-20", "SELECT id FROM v_via_ferrata_attr WHERE name IS NOT NULL")
def flt_20(spark, d):
    return view(spark, d, "v_via_ferrata_attr").filter(F.col("name").isNotNull()).select("id")


@query("FLT-23", "SELECT id, CASE WHEN elevation > 0 THEN CAST(elevation AS STRING) || 'm asl' ELSE '' END AS label FROM v_pois")
def flt_23(spark, d):
    return view(spark, d, "v_pois").select("id", F.when(F.col("elevation") > 0, F.concat(F.col("elevation").cast("string"), F.lit("m asl"))).otherwise("").alias("label"))


@query("FLT-25", "SELECT id, osm_id, type, name, elevation, lng, lat, CAST(NULL AS STRING) AS via_ferrata_scale, CAST(NULL AS STRING) AS sac_scale, CAST(NULL AS STRING) AS source_type FROM v_pois")
def flt_25(spark, d):
    nothing = [F.lit(None).cast("string").alias(c) for c in ("via_ferrata_scale", "sac_scale", "source_type")]
    return view(spark, d, "v_pois").select("id", "osm_id", "type", "name", "elevation", "lng", "lat", *nothing)


@query("FLT-26", "SELECT DISTINCT substring(name, 1, CAST(1 + id % 3 AS INTEGER)) AS q FROM v_pois WHERE length(substring(name, 1, CAST(1 + id % 3 AS INTEGER))) >= 2")
def flt_26(spark, d):
    q = view(spark, d, "v_pois").select(F.expr("substring(name, 1, cast(1 + id % 3 as int))").alias("q"))
    return q.filter(F.length("q") >= 2).distinct()


@query("FLT-28", "SELECT request_id, round(minx - 0.05, 9) AS minx, round(miny - 0.05, 9) AS miny, round(maxx + 0.05, 9) AS maxx, round(maxy + 0.05, 9) AS maxy FROM v_bbox_requests WHERE 8 + request_id % 6 >= 10")
def flt_28(spark, d):
    b = view(spark, d, "v_bbox_requests").withColumn("zoom", 8 + F.col("request_id") % 6).filter("zoom >= 10")
    return b.select("request_id", *(F.round(F.col(c) + s, 9).alias(c) for c, s in (("minx", -0.05), ("miny", -0.05), ("maxx", 0.05), ("maxy", 0.05))))


@query("FLT-29", "SELECT request_id, least(from_lng, to_lng) AS minx, least(from_lat, to_lat) AS miny, greatest(from_lng, to_lng) AS maxx, greatest(from_lat, to_lat) AS maxy FROM v_route_requests")
def flt_29(spark, d):
    return view(spark, d, "v_route_requests").select("request_id", F.least("from_lng", "to_lng").alias("minx"), F.least("from_lat", "to_lat").alias("miny"), F.greatest("from_lng", "to_lng").alias("maxx"), F.greatest("from_lat", "to_lat").alias("maxy"))


@query("FLT-30", "SELECT id, name FROM v_via_ferrata_attr WHERE 1 = 0")
def flt_30(spark, d):
    return view(spark, d, "v_via_ferrata_attr").filter(F.lit(False)).select("id", "name")


# ---- aggregates over lines ----


@query("AGG-2", """SELECT id, round(coalesce(sum(len * (lng + bx) / 2) / nullif(sum(len), 0), avg(lng)), 9) AS lng, round(coalesce(sum(len * (lat + by_) / 2) / nullif(sum(len), 0), avg(lat)), 9) AS lat FROM
(SELECT id, lng, lat, coalesce(bx, lng) AS bx, coalesce(by_, lat) AS by_, coalesce(sqrt(pow(bx - lng, 2) + pow(by_ - lat, 2)), 0) AS len FROM (SELECT id, lng, lat, lead(lng) OVER (PARTITION BY id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY id ORDER BY pos) AS by_ FROM v_via_ferrata_vertices)) GROUP BY id""")
def agg_2(spark, d):
    c = centroids(view(spark, d, "v_via_ferrata_vertices"), "id", ["id"])
    return c.select("id", F.round("lng", 9).alias("lng"), F.round("lat", 9).alias("lat"))


@query("AGG-9", f"SELECT osm_id, round(sum({hav('ax', 'ay', 'bx', 'by_')}) / 1000, 6) AS km FROM v_segments GROUP BY osm_id")
def agg_9(spark, d):
    return length_km(view(spark, d, "v_trail_vertices"), "osm_id").select("osm_id", F.round("km", 6).alias("km"))


@query("AGG-16", "SELECT min(lng) AS minx, min(lat) AS miny, max(lng) AS maxx, max(lat) AS maxy FROM v_pois WHERE type = 'hut'")
def agg_16(spark, d):
    return view(spark, d, "v_pois").filter("type = 'hut'").agg(F.min("lng").alias("minx"), F.min("lat").alias("miny"), F.max("lng").alias("maxx"), F.max("lat").alias("maxy"))


@query("WIN-7", "SELECT osm_id, pos, ax, ay, bx, by_ FROM v_segments")
def win_7(spark, d):
    return vertex_pairs(view(spark, d, "v_trail_vertices"), "osm_id").withColumnRenamed("by", "by_")


@query("TGF-3", "SELECT osm_id, CAST(pos - 1 AS INTEGER) AS i, ax, ay, bx, by_ FROM v_segments")
def tgf_3(spark, d):
    one = lines(view(spark, d, "v_trail_vertices"), "osm_id").select("osm_id", F.posexplode(geo.segments("line")).alias("i", "s"))
    return one.select("osm_id", "i", F.col("s.a.lng").alias("ax"), F.col("s.a.lat").alias("ay"), F.col("s.b.lng").alias("bx"), F.col("s.b.lat").alias("by_"))


@query("SRC-5", "SELECT osm_id, min(lng) AS minx, min(lat) AS miny, max(lng) AS maxx, max(lat) AS maxy FROM v_trail_vertices GROUP BY osm_id")
def src_5(spark, d):
    return boxes(view(spark, d, "v_trail_vertices"), "osm_id")
