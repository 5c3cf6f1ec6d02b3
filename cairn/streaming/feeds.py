"""Structured Streaming forms of the keyed writes, the progress of chunks, the quota, the expiring records and the bounded cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from cairn.operators.match import DAY_LIMIT, MONTH_LIMIT
from cairn.sources.sinks import upsert

#: Hash buckets of a keyed table; a batch writes those that it touches.
BUCKETS = 32
#: Keys of the bounded cache.
MOST_KEYS = 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyedTable:
    """A table with a key, in hash buckets under a folder, which numbered batches change.

    A batch reads the buckets that its keys fall into as the batches before it have left them,
    writes those anew under its own number, and then notes which they are.  A batch that runs
    again reads and writes the same, so nothing is counted twice; what it does not touch is
    neither read nor written.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, *key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def newest(self, before: int | None = None) -> list[tuple[int, int]]:
        """(bucket, number) of the last finished batch, of those before one, that has written each bucket."""
        try:
            notes = self.spark.read.schema("bucket int, number long").option("recursiveFileLookup", "true").parquet(f"{self.root}/notes")
        except Exception as error:  # no batch has finished
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return []
        notes = notes if before is None else notes.filter(F.col("number") < before)
        return [(r["bucket"], r["number"]) for r in notes.groupBy("bucket").agg(F.max("number").alias("number")).collect()]

    def rows(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/rows/{number}/bucket={bucket}" for bucket, number in self.newest(before) if only is None or bucket in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """merge gives the rows of the touched buckets from those before and the batch."""
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        if touched:
            merge(self.rows(number, touched), batch).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/{number}")
            self.spark.createDataFrame([(b, number) for b in sorted(touched)], "bucket int, number long").write.mode("overwrite").parquet(f"{self.root}/notes/{number}")


def each_batch(feed: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return feed.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed(spark: SparkSession, target: str, schema: str, key: str, seq: str = "seq") -> KeyedTable:
    """The table of upsert_stream."""
    columns = [c for c in spark.createDataFrame([], schema).drop(seq).schema]
    return KeyedTable(spark, target, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in columns), key)


def upsert_stream(spark: SparkSession, landed: str, schema: str, target: str, checkpoint: str, key: str = "osm_id", seq: str = "seq", files: int | None = None) -> StreamingQuery:
    """STR-1: landed Parquet files into a keyed table (keyed); a file that comes twice changes nothing."""
    table = keyed(spark, target, schema, key, seq)
    return each_batch(landed_files(spark, landed, schema, files), checkpoint, lambda batch, n: table.change(batch, n, lambda old, new: upsert(old, new, key, seq)))


def landed_files(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of landed Parquet files, so many in a batch."""
    read = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (read if files is None else read.option("maxFilesPerTrigger", files)).parquet(folder)


PROGRESS = "chunk long, attempts long, status string, last_error string, last long"


def progress_stream(spark: SparkSession, attempts: DataFrame, target: str, checkpoint: str) -> tuple[StreamingQuery, KeyedTable]:
    """STR-2: attempts (chunk, seq, error) into one row a chunk: how many, the latest status, and the last error; a batch that runs again raises no count."""
    table = KeyedTable(spark, target, PROGRESS, "chunk")

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        failed = F.when(F.col("error").isNotNull(), "failed").otherwise("completed")
        own = new.groupBy("chunk").agg(F.count("*").alias("attempts"), F.max_by(failed, "seq").alias("status"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error"), F.max("seq").alias("last"))
        order = F.struct("last", "attempts")
        both = old.withColumn("turn", F.lit(0)).unionByName(own.withColumn("turn", F.lit(1)))
        error = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("turn")))
        return both.groupBy("chunk").agg(F.sum("attempts").alias("attempts"), F.max_by("status", F.struct("last", "turn")).alias("status"), error.alias("last_error"), F.max("last").alias("last"))

    return each_batch(attempts, checkpoint, lambda batch, n: table.change(batch, n, merge)), table


def admitted_stream(spark: SparkSession, calls: DataFrame, target: str, checkpoint: str, day_limit: int = DAY_LIMIT, month_limit: int = MONTH_LIMIT) -> StreamingQuery:
    """STR-3: (quota, event_id) of the calls (quota, event_id, ts) let through, as Parquet under target/passed.

    A counter for each quota and day, and one for each quota and month, go on from batch to
    batch, so a call that comes late counts for its own day.  Within a batch calls go by (ts,
    event_id); of a day only as many as the limit are looked at, and of a month as many as its
    days let through.
    """
    days, months = (KeyedTable(spark, f"{target}/{p}", "quota string, period string, calls long", "quota", "period") for p in ("days", "months"))

    def room(fits: DataFrame, counted: DataFrame, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("quota", "period").orderBy("ts", "event_id"))
        first = fits.withColumn("rank", rank).filter(F.col("rank") <= most)
        return first.join(counted, ["quota", "period"], "left").filter(F.col("rank") + F.coalesce("calls", F.lit(0)) <= most).drop("rank", "calls")

    def count(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new.groupBy("quota", "period").agg(F.count("*").alias("calls")))
        return both.groupBy("quota", "period").agg(F.sum("calls").alias("calls"))

    def admit(batch: DataFrame, n: int) -> None:
        by_day = room(batch.withColumn("period", F.date_format("ts", "yyyy-MM-dd")), days.rows(n), day_limit)
        by_month = room(by_day.withColumn("period", F.date_format("ts", "yyyy-MM")), months.rows(n), month_limit)
        path = f"{target}/passed/batch={n}"
        by_month.select("quota", "event_id", "ts").write.mode("overwrite").parquet(path)
        passed = spark.read.schema("quota string, event_id long, ts timestamp").parquet(path)
        days.change(passed.withColumn("period", F.date_format("ts", "yyyy-MM-dd")), n, count)
        months.change(passed.withColumn("period", F.date_format("ts", "yyyy-MM")), n, count)

    return each_batch(calls, checkpoint, admit)


def cached_stream(spark: SparkSession, seen: DataFrame, target: str, checkpoint: str, most: int = MOST_KEYS) -> tuple[StreamingQuery, KeyedTable]:
    """STR-5: the newest keys, most at most, by when they were put in; seen is (key, seq).

    A key that is there keeps its place, the oldest goes for a new one, and one that has gone comes
    back as new.  Within a batch a key counts once, where it first comes.  The table is one bucket
    of at most most rows, and a batch brings no more than that many to it.
    """
    table = KeyedTable(spark, target, "one int, key long, first long", "one", buckets=1)

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.groupBy("key").agg(F.min("seq").alias("first")).join(old.select("key"), "key", "left_anti").select(F.lit(0).alias("one"), "key", "first")
        return old.unionByName(fresh).orderBy(F.desc("first"), F.desc("key")).limit(most)

    return each_batch(seen.withColumn("one", F.lit(0)), checkpoint, lambda batch, n: table.change(batch, n, merge)), table


def expiring() -> StatefulProcessor:
    """STR-4's state; the class is made here so that it goes to the workers as a whole, and not by the name of this module."""

    class Expiring(StatefulProcessor):
        """STR-4's state of a key: its latest record, until event time passes its end (in milliseconds)."""

        def init(self, handle) -> None:
            self.handle = handle
            self.latest = handle.getValueState("latest", "seq long, value string, ends long")

        # Each call of the state is a message to the executor, so no more are made than a change needs, and rows are no data frames of one row each.
        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            new = tuple(max(((r["seq"], r["value"], r["ends"]) for r in rows), key=lambda r: r[0]))
            old = self.latest.get()
            if old is not None and old[0] >= new[0]:
                return
            if old is not None:
                if old[2] != new[2]:
                    self.handle.deleteTimer(old[2])
                if old[2] <= timerValues.getCurrentWatermarkInMs():  # its timer would come after this
                    yield Row(key=key[0], seq=old[0], value=old[1], ends=old[2], change="expired")
            self.latest.update(new)
            if old is None or old[2] != new[2]:
                self.handle.registerTimer(new[2])
            yield Row(key=key[0], seq=new[0], value=new[1], ends=new[2], change="set")

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            old = self.latest.get()
            if old is not None:
                self.latest.clear()
                yield Row(key=key[0], seq=old[0], value=old[1], ends=old[2], change="expired")

        def close(self) -> None:
            pass

    return Expiring()


def expiring_stream(records: DataFrame, late: str = "0 seconds") -> DataFrame:
    """STR-4: (key, seq, value, expires, change) whenever a key is set, and when it expires in event time; records is (key, seq, value, ts, expires).

    What a key holds is dropped once it has expired, so the state is bounded by the records that
    are valid; a record of a lower seq than the held one changes nothing.  The session's state
    store has to be ROCKS.
    """
    each = records.withWatermark("ts", late).withColumn("ends", F.unix_millis("expires")).select("key", "seq", "value", "ends", "ts")
    changes = each.groupBy("key").transformWithState(expiring(), "key long, seq long, value string, ends long, change string", "Update", "EventTime")
    return changes.select("key", "seq", "value", F.timestamp_millis("ends").alias("expires"), "change")


def live_at(changes: DataFrame, now: str) -> DataFrame:
    """(key, seq, value) of the keys that are valid at a time, from the changes up to some later one."""
    latest = changes.filter("change = 'set'").groupBy("key").agg(F.max_by(F.struct("seq", "value", "expires"), "seq").alias("r"))
    return latest.filter(f"r.expires > {now}").select("key", "r.seq", "r.value")
