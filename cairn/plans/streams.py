"""Streams, run over all landed rows until they end."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.session import shared_folder
from cairn.plans.ingest import PROGRESS
from cairn.plans.matching import NOW, QUOTA
from cairn.plans.registry import query, table, view
from cairn.streaming import feeds


def batches(rows: DataFrame, folder: str, order: str, n: int = 3) -> None:
    """Lands rows as files in so many folders, which come one after another, in ranges of a column."""
    low, high = rows.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
    place = F.least(F.floor((F.col(order).cast("double") - low) / max((high or 0) - (low or 0), 1e-9) * n), F.lit(n - 1))
    for k in range(n):
        rows.filter(place == k).coalesce(1).write.parquet(f"{folder}/{k}")


def place(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid4().hex}"


@query("STR-1", "SELECT osm_id, CASE WHEN id % 2 = 0 THEN name || ' bis' ELSE name END AS name FROM v_pois")
def str_1(spark, d):
    """Features landed twice, half of them with a newer name."""
    p, folder = view(spark, d, "v_pois"), place(spark)
    rows = p.select("osm_id", "name", F.lit(0).cast("long").alias("seq")).unionAll(p.filter("id % 2 = 0").selectExpr("osm_id", "name || ' bis'", "1L"))
    batches(rows, f"{folder}/in", "seq", 2)
    schema = "osm_id long, name string, seq long"
    feeds.upsert_stream(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint", files=1).awaitTermination()
    return feeds.keyed(spark, f"{folder}/out", schema, "osm_id").rows()


@query("STR-2", f"WITH {PROGRESS} SELECT * FROM cp")
def str_2(spark, d):
    """Attempts at chunks in three batches."""
    e, folder = table(spark, d, "events"), place(spark)
    rows = e.select((F.col("event_id") % 165).alias("chunk"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"))
    batches(rows, f"{folder}/in", "seq")
    stream = feeds.landed_files(spark, f"{folder}/in", "chunk long, seq long, error string", 1)
    run, progress = feeds.progress_stream(spark, stream, f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    return progress.rows().select("chunk", "attempts", "status", "last_error")


@query("STR-3", QUOTA)
def str_3(spark, d):
    """Calls in order of time, in three batches, through a day's and a month's limit."""
    folder = place(spark)
    calls = view(spark, d, "v_quota_calls").select(F.lit("places").alias("quota"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    batches(calls, f"{folder}/in", "ts")
    stream = feeds.landed_files(spark, f"{folder}/in", "quota string, event_id long, ts timestamp", 1)
    feeds.admitted_stream(spark, stream, f"{folder}/out", f"{folder}/checkpoint", month_limit=4000).awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{folder}/out/passed").select("event_id")


@query("STR-4", f"SELECT cache_key, max(event_id) AS event_id FROM v_cache WHERE expires_at > {NOW} GROUP BY cache_key")
def str_4(spark, d):
    """Records in three batches of time; what is valid at a time is read from the changes."""
    folder = place(spark)
    c = view(spark, d, "v_cache")
    rows = c.select(F.col("cache_key").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("value"), F.col("generated_at").cast("timestamp").alias("ts"), F.col("expires_at").cast("timestamp").alias("expires"))
    batches(rows, f"{folder}/in", "ts")
    stream = feeds.landed_files(spark, f"{folder}/in", "key long, seq long, value string, ts timestamp, expires timestamp", 1)
    with_store(spark, lambda: feeds.expiring_stream(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    changes = spark.read.schema("key long, seq long, value string, expires timestamp, change string").parquet(f"{folder}/out")
    return feeds.live_at(changes, NOW).select(F.col("key").alias("cache_key"), F.col("seq").alias("event_id"))


def with_store(spark, run) -> None:
    """run with the state store that expiring_stream needs, and the session's own after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, feeds.ROCKS)
    try:
        run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query("STR-5", "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY min(event_id) DESC) AS r FROM events GROUP BY user_id) WHERE r <= 1000")
def str_5(spark, d):
    """Users in order of their first events, in three batches, through a cache of 1000."""
    folder = place(spark)
    batches(table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("seq")), f"{folder}/in", "seq")
    run, cache = feeds.cached_stream(spark, feeds.landed_files(spark, f"{folder}/in", "key long, seq long", 1), f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    return cache.rows().select(F.col("key").alias("user_id"))
