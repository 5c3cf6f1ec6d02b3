"""Writing: keyed tables without a merge command, and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import escape
from cairn.sources.osm import first_of_each


def insert_absent(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """SNK-1: old and the rows of new whose key old hasn't; of one key in new the first in order of seq."""
    fresh = first_of_each(new, key, seq).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """SNK-2: one row a key, the last of new where it has the key, else old's."""
    both = old.withColumn("_p", F.lit(0)).withColumn("_s", F.lit(0).cast("long")).unionByName(new.withColumn("_p", F.lit(1)).withColumn("_s", F.col(seq).cast("long")).select(*old.columns, "_p", "_s"))
    row = F.struct(*old.columns)
    return both.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct("_p", "_s")).alias("r")).select("r.*")


def coalescing_upsert(old: DataFrame, new: DataFrame, key: str, seq: str, keep: str) -> DataFrame:
    """SNK-3: like upsert, but column keep takes its last value that is not null."""
    both = old.withColumn("_p", F.lit(0)).withColumn("_s", F.lit(0).cast("long")).unionByName(new.withColumn("_p", F.lit(1)).withColumn("_s", F.col(seq).cast("long")).select(*old.columns, "_p", "_s"))
    order = F.struct("_p", "_s")
    held = F.max_by(keep, F.when(F.col(keep).isNotNull(), order))
    agg = both.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*old.columns), order).alias("r"), held.alias("_v"))
    return agg.select(*(F.col("_v").alias(c) if c == keep else F.col(f"r.{c}") for c in old.columns))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK-10, SNK-11: rows whose key is not in gone."""
    return df.join(gone.select(key), key, "left_anti")


def feature(geometry: Column, *properties: str) -> Column:
    """SNK-7: a row as a GeoJSON feature."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def point_geometry(lng: str, lat: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(lng).cast("double"), F.col(lat).cast("double")).alias("coordinates"))


def gpx(name: Column, points: Column) -> Column:
    """SNK-9: a track of points (lng, lat), seven decimals, points that repeat their neighbour once."""
    kept = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.when(i == 0, 1).otherwise(i).cast("int"))))
    place = lambda p: F.format_string('<trkpt lat="%.7f" lon="%.7f"></trkpt>', p["lat"].cast("double"), p["lng"].cast("double"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="cairn" xmlns="http://www.topografix.com/GPX/1/1">\n<trk><name>'
    return F.concat(F.lit(head), escape(name), F.lit("</name><trkseg>\n"), F.array_join(F.transform(kept, place), "\n"), F.lit("\n</trkseg></trk>\n</gpx>\n"))


def replace_table(df: DataFrame, path: str) -> None:
    """SNK-4, SNK-5: the whole table anew."""
    df.write.mode("overwrite").parquet(path)


def export_snapshot(routes: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """SNK-6: both tables in order as JSON lines under path; gives the counts."""
    routes.orderBy("osm_id").write.mode("overwrite").json(f"{path}/via_ferrata")
    chunks.orderBy("chunk_index").write.mode("overwrite").json(f"{path}/chunks")
    return routes.agg(F.count("*").alias("via_ferrata")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
