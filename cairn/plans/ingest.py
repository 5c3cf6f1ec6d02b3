"""Ingestion: landed files, map elements, keyed writes, progress."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cairn.functions.session import shared_folder
from cairn.functions.text import USEFUL_TAGS
from cairn.operators.lines import lines
from cairn.plans.registry import query, table, view
from cairn.sources import osm, sinks


def landed(spark, rows, name: str) -> str:
    """rows of one text column as files in the shared folder."""
    path = f"{shared_folder(spark)}/landed-{name}-{uuid4().hex}"
    rows.write.text(path)
    return path


@query("SRC-1", "SELECT osm_id, type, name, CAST(elevation AS INTEGER) AS elevation, lng, lat FROM v_pois")
def src_1(spark, d):
    p = view(spark, d, "v_pois")
    props = F.struct("id", F.when(F.col("id") % 2 == 0, F.col("osm_id")).alias("osm_id"), F.coalesce("name", F.lit("")).alias("name"), "type", F.coalesce(F.concat(F.col("elevation").cast("string"), F.lit(" m")), F.lit("0")).alias("elevation"))
    feature = F.struct(sinks.point_geometry("lng", "lat").alias("geometry"), props.alias("properties"))
    docs = p.groupBy((F.col("id") % 7).alias("part")).agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")))
    back = osm.read_poi_geojson(spark, landed(spark, docs, "pois"), multiline=False)
    fix = F.when(F.col("osm_id") < 1000000, F.col("osm_id") + 1000000).otherwise(F.col("osm_id"))
    return back.withColumn("osm_id", fix)


NODE = "CAST(round(lng * 1000) AS BIGINT) * 100000 + CAST(round(lat * 1000) AS BIGINT)"


def elements(spark, d):
    """Nodes, ways and relations of the trails, landed and read again."""
    v = view(spark, d, "v_trail_vertices").withColumn("node", F.expr(NODE))
    nodes = v.select("node", "lng", "lat").distinct().filter("node % 97 <> 0").select(F.struct(F.lit("node").alias("type"), F.col("node").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lon")).alias("e"))
    way = v.groupBy(F.col("osm_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))
    tags = F.create_map(F.lit("highway"), F.when(F.col("id") % 3 == 0, "track").when(F.col("id") % 3 == 1, "path").otherwise("footway"), F.when(F.col("id") % 2 == 0, "sac_scale").otherwise("surface"), F.lit("hiking"), F.when(F.col("id") % 6 == 3, "tracktype").otherwise("width"), F.concat(F.lit("grade"), (F.col("id") % 5 + 1).cast("string")))
    ways = way.select(F.struct(F.lit("way").alias("type"), "id", "nodes", tags.alias("tags")).alias("e"))
    rel = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.collect_list(F.struct(F.lit("way").alias("type"), (F.lit(2000000) + F.col("s_suppkey")).alias("ref"))).alias("members"))
    rels = rel.select(F.struct(F.lit("relation").alias("type"), "id", "members", F.create_map(F.lit("route"), F.when(F.col("id") % 4 != 3, "via_ferrata").otherwise("hiking"), F.lit("name"), F.concat(F.lit("Ferrata "), F.col("id").cast("string"))).alias("tags")).alias("e"))
    json = nodes.select(F.to_json("e").alias("j")).unionAll(ways.select(F.to_json("e"))).unionAll(rels.select(F.to_json("e")))
    docs = json.select(F.concat(F.lit('{"elements":['), "j", F.lit("]}")))
    return osm.read_osm_elements(spark, landed(spark, docs, "elements"), multiline=False)


TAGS = """wt AS (SELECT osm_id AS id, CASE osm_id % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'path' ELSE 'footway' END AS highway, CASE WHEN osm_id % 2 = 0 THEN 'hiking' END AS sac, CASE WHEN osm_id % 6 = 3 THEN 'grade' || CAST(osm_id % 5 + 1 AS STRING) END AS tracktype FROM (SELECT DISTINCT osm_id FROM v_trail_vertices))"""


@query("SRC-2", f"SELECT 'node' AS kind, count(*) AS n FROM (SELECT DISTINCT {NODE} AS node FROM v_trail_vertices) WHERE node % 97 <> 0 UNION ALL SELECT 'way', count(DISTINCT osm_id) FROM v_trail_vertices UNION ALL SELECT 'relation', count(DISTINCT s_nationkey) FROM supplier")
def src_2(spark, d):
    nodes, ways, relations = elements(spark, d)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(nodes, "node").unionAll(count(ways, "way")).unionAll(count(relations, "relation"))


@query("SRC-3", "SELECT osm_id, name, via_ferrata_scale, sac_scale, source_type FROM v_via_ferrata_attr")
def src_3(spark, d):
    routes = view(spark, d, "v_via_ferrata_attr").agg(F.collect_list(F.struct("osm_id", "name", "via_ferrata_scale", "sac_scale", "source_type")).alias("via_ferrata"))
    doc = routes.select(F.to_json(F.struct(F.lit("2024-01-01").alias("exportedAt"), "via_ferrata", F.expr("array(named_struct('chunk_key', 'a', 'chunk_index', 0))").alias("via_ferrata_import_chunks"))))
    return osm.read_ferrata_snapshot(spark, landed(spark, doc, "snapshot"), multiline=False)[0]


@query("SRC-4", "SELECT 'province' AS kind, name, count(*) AS vertices FROM v_admin_vertices GROUP BY name")
def src_4(spark, d):
    ring = lines(view(spark, d, "v_admin_vertices"), "name").select("name", F.transform("line", lambda p: F.array(p["lng"].cast("double"), p["lat"].cast("double"))).alias("ring"))
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"), F.create_map(F.lit("prov_name"), F.lit(" "), F.lit("name"), F.col("name")).alias("properties"))
    docs = ring.select(F.to_json(F.struct(F.array(feature).alias("features"))))
    back = osm.read_admin_areas(spark, landed(spark, docs, "areas"), "province", multiline=False)
    return back.select("kind", "name", F.size(F.flatten(F.flatten("polygons"))).cast("long").alias("vertices"))


@query("SRC-6", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def src_6(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SRC-7", "SELECT page_id, url, length(html) AS n FROM pages")
def src_7(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("SRC-8", "SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' END AS data_type FROM (DESCRIBE SELECT * FROM customer)")
def src_8(spark, d):
    c = table(spark, d, "customer")
    return spark.createDataFrame(c.dtypes, "column_name string, data_type string")


def optional_table(spark, path: str, schema: str):
    """SRC-9: the table, or no rows of its schema where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


@query("SRC-9", "SELECT osm_id, name FROM v_pois WHERE name ILIKE '%blue%'")
def src_9(spark, d):
    none = optional_table(spark, f"{d}/via_ferrata_not_landed.parquet", "osm_id long, name string")
    return view(spark, d, "v_pois").select("osm_id", "name").unionByName(none).filter(F.col("name").ilike("%blue%"))


@query("JOIN-3", f"SELECT osm_id AS id, count(*) AS n FROM (SELECT osm_id, {NODE} AS node FROM v_trail_vertices) GROUP BY osm_id HAVING count(*) >= 2 AND count_if(node % 97 = 0) = 0")
def join_3(spark, d):
    nodes, ways, _ = elements(spark, d)
    return osm.way_lines(ways, nodes).select("id", F.size("line").cast("long").alias("n"))


@query("FLT-18", f"SELECT count(*) AS whole FROM (SELECT osm_id FROM (SELECT osm_id, {NODE} AS node FROM v_trail_vertices) GROUP BY osm_id HAVING count(*) >= 2 AND count_if(node % 97 = 0) = 0)")
def flt_18(spark, d):
    nodes, ways, _ = elements(spark, d)
    return osm.way_lines(ways, nodes).agg(F.count("*").alias("whole"))


@query("JOIN-4", "SELECT w.id, r.s_nationkey::BIGINT AS relation_id, 'Ferrata ' || CAST(r.s_nationkey AS STRING) AS name FROM (SELECT DISTINCT osm_id AS id FROM v_trail_vertices) w LEFT JOIN (SELECT 2000000 + s_suppkey AS ref, s_nationkey FROM supplier WHERE s_nationkey % 4 <> 3) r ON r.ref = w.id")
def join_4(spark, d):
    _, ways, relations = elements(spark, d)
    return osm.with_relations(ways, relations).select("id", F.element_at("relation_ids", 1).alias("relation_id"), F.col("rel_tags")["name"].alias("name"))


@query("FLT-15", f"WITH {TAGS} SELECT id FROM wt WHERE highway = 'path' OR (highway = 'footway' AND sac IS NOT NULL) OR (highway = 'track' AND (tracktype IS NULL OR tracktype <> 'grade5'))")
def flt_15(spark, d):
    return elements(spark, d)[1].filter(osm.trail_admitted("tags")).select("id")


@query("FLT-16", f"WITH {TAGS} SELECT id, coalesce(sac, CASE WHEN highway = 'track' THEN 'track' END, 'unknown') AS sac_scale FROM wt")
def flt_16(spark, d):
    return elements(spark, d)[1].select("id", osm.trail_scale("tags").alias("sac_scale"))


@query("FLT-17", "SELECT id, via_ferrata_scale IS NOT NULL OR id % 2 = 0 AS explicit, CASE WHEN id % 2 = 0 THEN 'highway=via_ferrata' WHEN via_ferrata_scale IS NOT NULL THEN 'via_ferrata_scale' ELSE 'unknown' END AS kind FROM v_via_ferrata_attr")
def flt_17(spark, d):
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(F.col("id") % 2 == 0, "via_ferrata"), F.lit("via_ferrata_scale"), F.col("via_ferrata_scale")), lambda k, v: v.isNotNull())
    v = view(spark, d, "v_via_ferrata_attr").withColumn("tags", tags)
    return v.select("id", osm.explicit_ferrata("tags").alias("explicit"), osm.source_type("tags", F.lit(False)).alias("kind"))


@query("FLT-14", "SELECT osm_id, type, coalesce(name, 'Unknown (' || type || ')') AS name, CAST(elevation AS INTEGER) AS elevation, CASE WHEN id % 5 = 0 THEN 'http://a' ELSE '' END AS website FROM v_pois WHERE type <> 'peak' OR name IS NOT NULL")
def flt_14(spark, d):
    p = view(spark, d, "v_pois")
    tags = F.create_map(F.when(F.col("type") == "peak", "natural").otherwise("tourism"), F.when(F.col("type") == "hut", "alpine_hut").when(F.col("type") == "bivouac", "wilderness_hut").otherwise("peak"), F.lit("name"), F.col("name"), F.lit("ele"), F.col("elevation").cast("string"), F.lit("contact:website"), F.when(F.col("id") % 5 == 0, "http://a"))
    e = p.select(F.col("osm_id").alias("id"), F.col("lat").alias("lat"), F.col("lng").alias("lon"), tags.alias("tags"))
    return osm.poi_rows(e).select("osm_id", "type", "name", "elevation", "website")


@query("FLT-21", "SELECT id, concat_ws(chr(10), 'name: ' || coalesce(name, '-'), 'via ferrata scale: ' || coalesce(via_ferrata_scale, '-'), 'contact › website: http://a') AS lines FROM v_via_ferrata_attr")
def flt_21(spark, d):
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    tags = F.create_map(F.lit("name"), dash("name"), F.lit("surface"), F.lit("rock"), F.lit("via_ferrata_scale"), dash("via_ferrata_scale"), F.lit("contact:website"), F.lit("http://a"))
    useful = F.map_filter(tags, lambda k, v: k.isin(USEFUL_TAGS))
    line = lambda e: F.concat(F.replace(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(":"), F.lit(" › ")), F.lit(": "), e["value"])
    return view(spark, d, "v_via_ferrata_attr").select("id", F.array_join(F.transform(F.map_entries(useful), line), "\n").alias("lines"))


@query("FLT-22", "SELECT id, name, 'Grade ' || via_ferrata_scale AS label, 'No description' AS description FROM v_via_ferrata_attr")
def flt_22(spark, d):
    return view(spark, d, "v_via_ferrata_attr").select("id", "name", F.concat(F.lit("Grade "), "via_ferrata_scale").alias("label"), F.coalesce(F.lit(None).cast("string"), F.lit("No description")).alias("description"))


# Line colours by grade of difficulty.
COLOURS = {
    "track": "#9E9E9E", "footway": "#B0BEC5", "bridleway": "#8D6E63", "steps": "#607D8B", "cycleway": "#26A69A", "hiking": "#4CAF50", "mountain_hiking": "#FFC107",
    "demanding_mountain_hiking": "#FF9800", "alpine_hiking": "#F44336", "demanding_alpine_hiking": "#9C27B0", "difficult_alpine_hiking": "#000000", "unknown": "#9E9E9E",
}


@query("FLT-24", "SELECT osm_id, CASE sac_scale " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items()) + " ELSE '#9E9E9E' END AS colour FROM v_trails_attr")
def flt_24(spark, d):
    colours = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return view(spark, d, "v_trails_attr").select("osm_id", F.coalesce(F.element_at(colours, F.col("sac_scale")), F.lit("#9E9E9E")).alias("colour"))


@query("FLT-27", "SELECT id, CASE WHEN id % 4 = 0 THEN 9.5 ELSE lng END AS lng FROM v_pois")
def flt_27(spark, d):
    own = F.when(F.col("id") % 4 != 0, F.col("lng").cast("double"))
    return view(spark, d, "v_pois").select("id", F.coalesce(F.when(~F.isnan(own), own), F.lit(9.5)).alias("lng"))


OLD = "old AS (SELECT osm_id, name, elevation FROM v_pois WHERE id % 3 <> 0)"
NEW = "new_ AS (SELECT osm_id, name || ' bis' AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE elevation + 1 END AS elevation, id AS seq FROM v_pois WHERE id % 2 = 0 UNION ALL SELECT osm_id, name || ' ter', CASE WHEN id % 8 = 0 THEN elevation + 2 END, id + 100000000 FROM v_pois WHERE id % 5 = 0)"


def old_new(spark, d):
    p = view(spark, d, "v_pois")
    old = p.filter("id % 3 <> 0").select("osm_id", "name", "elevation")
    one = p.filter("id % 2 = 0").selectExpr("osm_id", "name || ' bis' as name", "case when id % 4 = 0 then null else elevation + 1 end as elevation", "id as seq")
    two = p.filter("id % 5 = 0").selectExpr("osm_id", "name || ' ter' as name", "case when id % 8 = 0 then elevation + 2 end as elevation", "id + 100000000 as seq")
    return old, one.unionAll(two)


@query("SNK-1", f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT osm_id, name, elevation FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY seq) AS r FROM new_) WHERE r = 1 AND osm_id NOT IN (SELECT osm_id FROM old)")
def snk_1(spark, d):
    return sinks.insert_absent(*old_new(spark, d), "osm_id", "seq")


LAST = "last_ AS (SELECT osm_id, name, elevation FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY seq DESC) AS r FROM new_) WHERE r = 1)"


@query("SNK-2", f"WITH {OLD}, {NEW}, {LAST} SELECT * FROM last_ UNION ALL SELECT * FROM old WHERE osm_id NOT IN (SELECT osm_id FROM new_)")
def snk_2(spark, d):
    return sinks.upsert(*old_new(spark, d), "osm_id", "seq")


@query("SNK-3", f"""WITH {OLD}, {NEW}, {LAST}, h AS (SELECT osm_id, arg_max(elevation, seq) FILTER (WHERE elevation IS NOT NULL) AS e FROM new_ GROUP BY osm_id),
m AS (SELECT * FROM last_ UNION ALL SELECT * FROM old WHERE osm_id NOT IN (SELECT osm_id FROM new_))
SELECT m.osm_id, m.name, coalesce(h.e, old.elevation) AS elevation FROM m LEFT JOIN h USING (osm_id) LEFT JOIN old ON old.osm_id = m.osm_id""")
def snk_3(spark, d):
    return sinks.coalescing_upsert(*old_new(spark, d), "osm_id", "seq", "elevation")


def rewritten(spark, df):
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    sinks.replace_table(df, path)
    return spark.read.parquet(path)


@query("SNK-4", "SELECT area_id, kind, name, count(*) AS n FROM v_admin_vertices GROUP BY area_id, kind, name")
def snk_4(spark, d):
    return rewritten(spark, view(spark, d, "v_admin_vertices")).groupBy("area_id", "kind", "name").agg(F.count("*").alias("n"))


@query("SNK-5", "SELECT osm_id, name FROM v_via_ferrata_attr")
def snk_5(spark, d):
    return rewritten(spark, view(spark, d, "v_via_ferrata_attr").select("osm_id", "name"))


@query("SNK-6", "SELECT (SELECT count(*) FROM v_via_ferrata_attr) AS via_ferrata, (SELECT count(*) FROM v_bbox_requests) AS chunks")
def snk_6(spark, d):
    chunks = view(spark, d, "v_bbox_requests").withColumn("chunk_index", F.col("request_id"))
    return sinks.export_snapshot(view(spark, d, "v_via_ferrata_attr"), chunks, f"{shared_folder(spark)}/snapshot-{uuid4().hex}")


@query("SNK-7", """SELECT osm_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(CAST(lng AS DOUBLE) AS STRING) || ',' || CAST(CAST(lat AS DOUBLE) AS STRING) || ']},"properties":{"osm_id":' || CAST(osm_id AS STRING) || ',"type":"' || type || '"}}' AS feature FROM v_pois""")
def snk_7(spark, d):
    return view(spark, d, "v_pois").select("osm_id", sinks.feature(sinks.point_geometry("lng", "lat"), "osm_id", "type").alias("feature"))


@query("SNK-8", f"WITH {OLD}, {NEW} SELECT count_if(o.osm_id IS NULL)::BIGINT AS added, count_if(o.osm_id IS NOT NULL)::BIGINT AS refreshed FROM (SELECT DISTINCT osm_id FROM new_) n LEFT JOIN old o USING (osm_id)")
def snk_8(spark, d):
    old, new = old_new(spark, d)
    both = new.select("osm_id").distinct().withColumn("new", F.lit(True)).join(old.select("osm_id", F.lit(True).alias("old")), "osm_id", "full")
    return both.agg(F.count_if(F.col("new") & F.col("old").isNull()).alias("added"), F.count_if(F.col("new") & F.col("old")).alias("refreshed"))


@query("SNK-9", """SELECT osm_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="cairn" xmlns="http://www.topografix.com/GPX/1/1">' || chr(10) || '<trk><name>' || replace(name, '&', '&amp;') || '</name><trkseg>' || chr(10) || pts || chr(10) || '</trkseg></trk>' || chr(10) || '</gpx>' || chr(10) AS gpx FROM
(SELECT osm_id, string_agg(printf('<trkpt lat="%.7f" lon="%.7f"></trkpt>', CAST(lat AS DOUBLE), CAST(lng AS DOUBLE)), chr(10) ORDER BY pos) AS pts FROM v_trail_vertices GROUP BY osm_id) JOIN v_trails_attr USING (osm_id)""")
def snk_9(spark, d):
    one = lines(view(spark, d, "v_trail_vertices"), "osm_id").join(view(spark, d, "v_trails_attr"), "osm_id")
    return one.select("osm_id", sinks.gpx(F.col("name"), F.col("line")).alias("gpx"))


@query("SNK-10", "SELECT event_id FROM v_cache WHERE cache_key NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def snk_10(spark, d):
    gone = table(spark, d, "events").filter("event_type = 'error' and value > 100").select(F.col("user_id").alias("cache_key")).distinct()
    return sinks.without(view(spark, d, "v_cache"), gone, "cache_key").select("event_id")


@query("SNK-11", "SELECT request_id FROM v_bbox_requests WHERE request_id % 5 <> 0")
def snk_11(spark, d):
    b = view(spark, d, "v_bbox_requests")
    return sinks.without(b, b.filter("request_id % 5 = 0"), "request_id").select("request_id")


PROGRESS = "cp AS (SELECT event_id % 165 AS chunk, count(*) AS attempts, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END, event_id) AS status, arg_max(event_type, event_id) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1)"


def chunk_progress(spark, d):
    """Attempts, latest status and last error of each chunk."""
    e = table(spark, d, "events").withColumn("chunk", F.col("event_id") % 165)
    failed = F.col("event_type") == "error"
    return e.groupBy("chunk").agg(F.count("*").alias("attempts"), F.max_by(F.when(failed, "failed").otherwise("completed"), "event_id").alias("status"), F.max_by(F.when(failed, F.col("event_type")), F.when(failed, F.col("event_id"))).alias("last_error"))


@query("AGG-5", f"WITH {PROGRESS} SELECT 200 AS total, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, greatest(200 - count(*), 0)::BIGINT AS pending FROM cp")
def agg_5(spark, d):
    done = lambda s: F.count_if(F.col("status") == s)
    return chunk_progress(spark, d).agg(F.lit(200).alias("total"), done("completed").alias("completed"), done("failed").alias("failed"), F.greatest(F.lit(200) - F.count("*"), F.lit(0)).alias("pending"))


@query("SNK-12", f"WITH {PROGRESS} SELECT chunk FROM cp WHERE status = 'failed' ORDER BY chunk")
def snk_12(spark, d):
    return chunk_progress(spark, d).filter("status = 'failed'").select("chunk").orderBy("chunk")


@query("JOIN-22", f"WITH {PROGRESS} SELECT k AS chunk, status FROM (SELECT CAST(unnest(range(200)) AS BIGINT) AS k) LEFT JOIN cp ON cp.chunk = k WHERE coalesce(status, 'failed') <> 'completed'")
def join_22(spark, d):
    return spark.range(200).toDF("chunk").join(chunk_progress(spark, d), "chunk", "left").filter("coalesce(status, 'failed') <> 'completed'").select("chunk", "status")


@query("AGG-6", f"WITH {OLD}, {NEW} SELECT (SELECT count(*) FROM new_) AS parsed, (SELECT count(DISTINCT osm_id) FROM new_) AS attempted, (SELECT count(DISTINCT osm_id) FROM new_ WHERE osm_id NOT IN (SELECT osm_id FROM old)) AS fresh, (SELECT count(DISTINCT osm_id) FROM new_ WHERE osm_id IN (SELECT osm_id FROM old)) AS skipped")
def agg_6(spark, d):
    old, new = old_new(spark, d)
    each = new.groupBy("osm_id").agg(F.count("*").alias("n")).join(old.select("osm_id", F.lit(True).alias("old")), "osm_id", "left")
    return each.agg(F.sum("n").alias("parsed"), F.count("*").alias("attempted"), F.count_if(F.col("old").isNull()).alias("fresh"), F.count_if(F.col("old")).alias("skipped"))


@query("AGG-7", "SELECT (SELECT count(*) FROM v_via_ferrata_attr) AS via_ferrata, (SELECT count(*) FROM v_admin_vertices) AS vertices")
def agg_7(spark, d):
    return view(spark, d, "v_via_ferrata_attr").agg(F.count("*").alias("via_ferrata")).crossJoin(view(spark, d, "v_admin_vertices").agg(F.count("*").alias("vertices")))


@query("JOIN-17", "SELECT p.osm_id, coalesce(p.elevation, CAST(floor(s.e + 0.5) AS BIGINT)) AS elevation FROM v_pois p LEFT JOIN (SELECT c_custkey AS id, c_acctbal AS e FROM customer WHERE c_custkey % 2 = 0) s ON s.id = p.id")
def join_17(spark, d):
    samples = table(spark, d, "customer").filter("c_custkey % 2 = 0 and c_acctbal is not null and not isnan(c_acctbal)").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") + 0.5).alias("e"))
    return view(spark, d, "v_pois").join(samples, "id", "left").select("osm_id", F.coalesce("elevation", "e").alias("elevation"))
