"""Streams in batches that come one after another, some of them twice, against plain bookkeeping."""

import random
from collections import OrderedDict, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairn.operators.match import admitted
from cairn.plans.streams import with_store
from cairn.streaming import feeds

RNG = random.Random(7)


def land(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")


def test_upserts_write_only_the_buckets_that_they_touch(spark, tmp_path):
    schema = "osm_id long, name string, seq long"
    batches = [[(i, f"n{i}", 1) for i in range(200)], [(5, "old", 0), (5, "new", 2), (900, "x", 2)], [(7, "again", 3)]]
    land(spark, f"{tmp_path}/in", batches, schema)
    feeds.upsert_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint", files=1).awaitTermination()
    table = feeds.keyed(spark, f"{tmp_path}/out", schema, "osm_id")
    want = {i: f"n{i}" for i in range(200)} | {5: "new", 900: "x", 7: "again"}
    assert {r.osm_id: r.name for r in table.rows().collect()} == want
    assert len(list((tmp_path / "out/rows/2").glob("bucket=*"))) == 1 and len(list((tmp_path / "out/rows/0").glob("bucket=*"))) == feeds.BUCKETS
    # The last batch once more, as after a failure before its offset was noted.
    last = spark.createDataFrame(batches[2], schema)
    table.change(last, 2, lambda old, new: feeds.upsert(old, new, "osm_id", "seq"))
    assert {r.osm_id: r.name for r in table.rows().collect()} == want


def test_a_replayed_batch_raises_no_attempts(spark, tmp_path):
    schema = "chunk long, seq long, error string"
    rows = [(RNG.randrange(12), i, RNG.choice([None, "timeout", "busy"])) for i in range(90)]
    batches = [rows[:30], rows[30:60], rows[60:]]
    land(spark, f"{tmp_path}/in", batches, schema)
    run = lambda checkpoint: feeds.progress_stream(spark, feeds.landed_files(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", checkpoint)
    query, table = run(f"{tmp_path}/one")
    query.awaitTermination()
    own = defaultdict(list)
    for c, i, e in rows:
        own[c].append((i, e))
    want = {c: (len(x), "failed" if x[-1][1] else "completed", next((e for _, e in x[::-1] if e), None)) for c, x in own.items()}
    found = lambda: {r.chunk: (r.attempts, r.status, r.last_error) for r in table.rows().collect()}
    assert found() == want
    run(f"{tmp_path}/two")[0].awaitTermination()  # a lost checkpoint: all batches run again under their numbers
    assert found() == want


def test_late_calls_count_for_their_own_day(spark, tmp_path):
    start = datetime(2024, 1, 30)
    calls = [(RNG.choice("ab"), i, start + timedelta(minutes=RNG.randrange(4 * 1440))) for i in range(160)]
    early = sorted((c for c in calls if c[1] % 5), key=lambda c: c[2])
    late = [c for c in calls if not c[1] % 5]
    batches = [early[:60], early[60:], late]
    schema = "quota string, event_id long, ts timestamp"
    land(spark, f"{tmp_path}/in", batches, schema)
    passed = []
    run = lambda checkpoint: feeds.admitted_stream(spark, feeds.landed_files(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", checkpoint, 9, 25).awaitTermination()
    days, months = defaultdict(int), defaultdict(int)
    for batch in batches:
        for quota, i, ts in sorted(batch, key=lambda c: (c[2], c[1])):
            day, month = (quota, ts.date()), (quota, ts.year, ts.month)
            if days[day] < 9 and months[month] < 25:
                days[day], months[month] = days[day] + 1, months[month] + 1
                passed.append(i)
    for checkpoint in ("one", "two"):
        run(f"{tmp_path}/{checkpoint}")
        assert sorted(r.event_id for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/passed").collect()) == sorted(passed)
    # In order and in one batch: the batch form.
    land(spark, f"{tmp_path}/all", [calls], schema)
    feeds.admitted_stream(spark, feeds.landed_files(spark, f"{tmp_path}/all", schema), f"{tmp_path}/whole", f"{tmp_path}/three", 9, 25).awaitTermination()
    every = spark.createDataFrame([c for c in calls], schema)
    batch = [admitted(every.filter(F.col("quota") == q).withColumns({"day": F.date_trunc("day", "ts"), "month": F.date_trunc("month", "ts")}), 9, 25).select("event_id") for q in "ab"]
    assert sorted(r[0] for b in batch for r in b.collect()) == sorted(r.event_id for r in spark.read.schema(schema).parquet(f"{tmp_path}/whole/passed").collect())


def test_a_cache_of_bounded_keys_drops_the_oldest(spark, tmp_path):
    batches = [[(k, k) for k in range(900)], [(k, 2000 + k) for k in range(850, 1300)], [(k, 4000 + n) for n, k in enumerate([5, 1299, 2000, 5, *range(3000, 3020)])]]
    land(spark, f"{tmp_path}/in", batches, "key long, seq long")
    query, table = feeds.cached_stream(spark, feeds.landed_files(spark, f"{tmp_path}/in", "key long, seq long", 1), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    cache = OrderedDict()
    for batch in batches:
        for k, seq in batch:
            if k not in cache:
                cache[k] = seq
        while len(cache) > 1000:
            cache.popitem(last=False)
    assert len(cache) == 1000 and 5 in cache and 900 in cache
    assert {r.key: r.first for r in table.rows().collect()} == dict(cache)


@pytest.mark.parametrize("late", ["0 seconds"])
def test_a_key_expires_and_comes_back(spark, tmp_path, late):
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    row = lambda key, seq, hours, keep=48: (key, seq, f"v{seq}", at(hours), at(hours + keep))
    batches = [[row(1, 1, 0), row(2, 2, 1), row(1, 3, 2)], [row(3, 4, 60)], [row(1, 5, 61), row(2, 6, 110, 1)], [row(4, 7, 200)]]
    schema = "key long, seq long, value string, ts timestamp, expires timestamp"
    land(spark, f"{tmp_path}/in", batches, schema)
    stream = feeds.expiring_stream(feeds.landed_files(spark, f"{tmp_path}/in", schema, 1), late)
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    with_store(spark, lambda: stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    changes = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    found = sorted((r.key, r.seq, r.change) for r in changes.collect())
    assert found == sorted([(1, 3, "set"), (2, 2, "set"), (3, 4, "set"), (1, 3, "expired"), (2, 2, "expired"), (1, 5, "set"), (2, 6, "set"), (3, 4, "expired"), (1, 5, "expired"), (2, 6, "expired"), (4, 7, "set")])
    rows = [r for b in batches for r in b]
    for hours in (10, 49, 62, 108.5, 111.5, 300):
        latest = {}
        for r in rows:
            latest[r[0]] = max(latest.get(r[0], r), r, key=lambda x: x[1])
        want = {(k, r[1], r[2]) for k, r in latest.items() if r[4] > at(hours)}
        assert {tuple(r) for r in feeds.live_at(changes, f"timestamp'{at(hours)}'").collect()} == want


def test_a_change_of_a_key_asks_little_of_the_state():
    """Each call of a state is a message between processes; before, a new key took four, and rows went through a data frame for each key."""
    calls = []

    class Handle:
        held = None

        def getValueState(self, *_):
            return self

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, held):
            calls.append("update")
            self.held = held

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 10

    state = feeds.expiring()
    state.init(Handle())
    put = lambda *rows: [(r["seq"], r["change"]) for r in state.handleInputRows((1,), iter([Row(key=1, seq=s, value="v", ends=e) for s, e in rows]), Clock())]
    for rows, changes, asked in [
        ([(2, 5), (3, 20), (1, 9)], [(3, "set")], ["get", "update", "register"]),
        ([(2, 90)], [], ["get"]),
        ([(4, 20)], [(4, "set")], ["get", "update"]),
        ([(5, 8)], [(5, "set")], ["get", "delete", "update", "register"]),
        ([(6, 30)], [(5, "expired"), (6, "set")], ["get", "delete", "update", "register"]),
    ]:
        calls.clear()
        assert (put(*rows), calls) == (changes, asked)
