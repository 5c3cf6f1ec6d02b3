"""Where queries and their SQL are kept, and the views of the given tables that stand for mountain data."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Said alike by Spark and DuckDB.
VIEWS = {
    "v_pois": """SELECT c_custkey AS id, 1000000 + c_custkey AS osm_id,
  CASE c_custkey % 4 WHEN 0 THEN 'hut' WHEN 1 THEN 'bivouac' ELSE 'peak' END AS type,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat(CASE c_custkey % 4 WHEN 0 THEN 'Rifugio ' WHEN 1 THEN 'Bivacco ' ELSE 'Monte ' END, p_name, ' ', CAST(c_custkey % 7 AS STRING)) END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 400 + (c_custkey * 37) % 3600 END AS elevation,
  (7400 + (c_custkey * 7919) % 4400) / 1000 AS lng, (45300 + (c_custkey * 104729) % 1500) / 1000 AS lat
FROM customer JOIN part ON p_partkey = c_custkey""",
    "v_trails_attr": """SELECT 2000000 + o_orderkey AS osm_id,
  CASE o_orderkey % 10 WHEN 0 THEN concat('Ferrata ', p_name) WHEN 1 THEN concat('Sentiero ', p_name) WHEN 2 THEN '' ELSE concat('Via ', p_name) END AS name,
  CASE o_orderkey % 8 WHEN 0 THEN 'hiking' WHEN 1 THEN 'mountain_hiking' WHEN 2 THEN 'demanding_mountain_hiking' WHEN 3 THEN 'alpine_hiking' WHEN 4 THEN 'demanding_alpine_hiking' WHEN 5 THEN 'difficult_alpine_hiking' WHEN 6 THEN 'track' ELSE 'unknown' END AS sac_scale
FROM orders CROSS JOIN (SELECT count(*) AS parts FROM part) n JOIN part ON p_partkey = o_orderkey % parts""",
    "v_trail_vertices": """SELECT 2000000 + l_orderkey AS osm_id, pos,
  (9000 + (l_orderkey * 31) % 200 + pos) / 1000 AS lng, (46000 + (l_orderkey * 17) % 100 + CAST(floor(pos / 2) AS BIGINT)) / 1000 AS lat
FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS pos FROM lineitem) t""",
    "v_via_ferrata_attr": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 2000000 + s_suppkey * 10 ELSE 3000000 + s_suppkey END AS osm_id,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE concat('Ferrata ', n_name) END AS name,
  CASE s_suppkey % 13 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN '1' WHEN 7 THEN '2' WHEN 8 THEN '3' WHEN 9 THEN '4' WHEN 10 THEN '5' WHEN 11 THEN '6' ELSE NULL END AS via_ferrata_scale,
  CASE s_suppkey % 3 WHEN 0 THEN 'alpine_hiking' WHEN 1 THEN 'demanding_alpine_hiking' ELSE NULL END AS sac_scale,
  CASE s_suppkey % 2 WHEN 0 THEN 'highway=via_ferrata' ELSE 'via_ferrata_scale' END AS source_type
FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "v_via_ferrata_vertices": """SELECT s_suppkey AS id, pos, (9000 + (s_suppkey * 53) % 200 + pos) / 1000 AS lng, (46000 + (s_suppkey * 29) % 100 + pos * (s_suppkey % 3)) / 1000 AS lat
FROM supplier CROSS JOIN (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3) p""",
    "v_admin_vertices": """SELECT n_nationkey AS area_id, 'province' AS kind, n_name AS name, 0 AS ring, v AS pos,
  (7840 + 880 * (n_nationkey % 5) + CASE v WHEN 2 THEN 440 WHEN 4 THEN -440 ELSE 0 END) / 1000 AS lng,
  (45450 + 300 * CAST(floor(n_nationkey / 5) AS BIGINT) + CASE v WHEN 1 THEN 150 WHEN 3 THEN -150 WHEN 5 THEN 150 ELSE 0 END) / 1000 AS lat
FROM nation CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) x""",
    "v_bbox_requests": """SELECT n_nationkey AS request_id, (7400 + 150 * n_nationkey) / 1000 AS minx, (45300 + 40 * n_nationkey) / 1000 AS miny,
  (7400 + 150 * n_nationkey + 300 + 60 * (n_nationkey % 6)) / 1000 AS maxx, (45300 + 40 * n_nationkey + 200) / 1000 AS maxy FROM nation""",
    "v_route_requests": """SELECT s_suppkey AS request_id, (9000 + (s_suppkey * 41) % 190) / 1000 AS from_lng, (46000 + (s_suppkey * 13) % 95) / 1000 AS from_lat,
  (9000 + (s_suppkey * 67 + 40) % 190) / 1000 AS to_lng, (46000 + (s_suppkey * 19 + 30) % 95) / 1000 AS to_lat FROM supplier""",
    "v_places": """SELECT id * 10 + k AS place_id, id AS near_poi,
  CASE k WHEN 0 THEN name WHEN 1 THEN concat(name, '-Tempesti') WHEN 2 THEN concat('Ostello ', name) ELSE concat('Baita ', CAST(id % 7 AS STRING)) END AS display_name,
  lng AS lng, lat + (k * 70 + id % 50) / 111320 AS lat, CASE WHEN id % 9 = k THEN 'parking' ELSE 'lodging' END AS primary_type
FROM v_pois CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE type <> 'peak' AND name IS NOT NULL""",
    "v_cache": "SELECT user_id AS cache_key, event_id, ts AS generated_at, ts + INTERVAL '48' HOUR AS expires_at FROM events WHERE event_type = 'view'",
    "v_quota_calls": "SELECT event_id, ts, date_trunc('day', ts) AS day, date_trunc('month', ts) AS month FROM events",
    "v_segments": """SELECT osm_id, pos, lng AS ax, lat AS ay, bx, by_ FROM (SELECT osm_id, pos, lng, lat, lead(lng) OVER (PARTITION BY osm_id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY osm_id ORDER BY pos) AS by_ FROM v_trail_vertices) s WHERE bx IS NOT NULL""",
    "v_ferrata_segments": """SELECT id, pos, lng AS ax, lat AS ay, bx, by_ FROM (SELECT id, pos, lng, lat, lead(lng) OVER (PARTITION BY id ORDER BY pos) AS bx, lead(lat) OVER (PARTITION BY id ORDER BY pos) AS by_ FROM v_via_ferrata_vertices) s WHERE bx IS NOT NULL""",
}

#: Rows of the same views, said for Spark alone.  A condition on columns of two tables of three makes
#: it join those two first, whether or not they have a key in common: here orders with all parts.
FOR_SPARK = {
    "v_trails_attr": VIEWS["v_trails_attr"].replace(
        "FROM orders CROSS JOIN (SELECT count(*) AS parts FROM part) n JOIN part ON p_partkey = o_orderkey % parts",
        "FROM (SELECT o_orderkey, o_orderkey % (SELECT nullif(count(*), 0) FROM part) AS nth FROM orders) o JOIN part ON p_partkey = nth",
    ),
}


def needed(sql: str, views: dict[str, str] = VIEWS, seen: list[str] | None = None) -> list[str]:
    """Views that sql names, those they are made of first."""
    seen = [] if seen is None else seen
    for name in re.findall(r"\bv_\w+", sql):
        if name in views and name not in seen:
            needed(views[name], views, seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, said: dict[str, str] = VIEWS) -> str:
    """sql with the views that it names before it."""
    views = [f"{name} AS ({said[name]})" for name in needed(sql, said)]
    if not views:
        return sql
    body = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    head = "WITH RECURSIVE " if body and body[1] else "WITH "
    return head + ",\n".join(views) + (",\n" + sql[body.end() :] if body else "\n" + sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet files."""
    sql = with_views(f"SELECT * FROM {name}", VIEWS | FOR_SPARK)
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query under its operator's number, and SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql.strip())
        return f

    return add
