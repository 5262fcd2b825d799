"""Streams that are broken off and started again, against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import ordered


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(ordered.PROVIDER)
    spark.conf.set(ordered.PROVIDER, ordered.ROCKSDB)
    yield
    spark.conf.set(ordered.PROVIDER, before)


def test_ordered_changes_equal_batch_over_restarts(spark, tmp_path, rocksdb):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), 1_700_000_000 + 60 * k + rng.randrange(60), k // 7 % 4 + rng.randrange(2)) for k in range(400)]
    late = [rows[k] for k in sorted(range(len(rows)), key=lambda k: k + rng.randrange(8))]  # at most ten minutes out of order
    schema = "who string, at long, frame long"
    source, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    stream = None
    for k in range(0, 400, 100):
        spark.createDataFrame(late[k : k + 100] + [(None, 5, 1), ("a", None, 1)], schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
        stream = ordered.ordered_changes(events, "who", "ts", "frame", "20 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        stream.awaitTermination()  # each run goes on from the checkpoint of the one before
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    end = max(r[1] for r in rows) - 1200
    want = ordered.ordered_changes(batch, "who", "ts", "frame", "20 minutes").filter(F.unix_seconds("ts") <= end).collect()
    got = spark.read.parquet(out).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50


def test_idle_keys_forget_their_frame(spark, tmp_path, rocksdb):
    start = 1_700_000_000
    rows = [("a", start, 1), ("a", start + 10, 1), ("a", start + 5000, 1), ("b", start + 9000, 2), ("b", start + 9900, 2)]
    schema = "who string, at long, frame long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("at"))
    q = ordered.ordered_changes(events, "who", "ts", "frame", "1 second", idle_seconds=1000).writeStream.format("memory").queryName("idle_keys").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start()
    q.awaitTermination()
    batch = ordered.ordered_changes(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")), "who", "ts", "frame", "1 second", idle_seconds=1000)
    end = F.unix_seconds("ts") <= start + 9899
    assert sorted(map(tuple, spark.table("idle_keys").collect())) == sorted(map(tuple, batch.filter(end).collect()))
    assert batch.count() == 3


@pytest.mark.parametrize(("kind", "keys", "idle", "more"), [("long", 1500, None, {}), ("date", 40, 900.0, {"shards": 3}), ("string", 40, 900.0, {"shards": 1})])
def test_ordered_changes_are_kept_by_shard(spark, tmp_path, rocksdb, kind, keys, idle, more):
    rng = random.Random(7)
    rows = [(rng.randrange(keys), 1_700_000_000_000_000 + 2_000_000 * k + rng.randrange(2_000_000), rng.randrange(3)) for k in range(6000)]
    rows += [(1, 1_700_000_000_000_000 + 2_000_000 * k, f) for k in range(0, 6000, 7) for f in (2, 0)]  # two frames at one time
    rows.sort(key=lambda r: r[1] + rng.randrange(200_000_000))
    key = F.date_from_unix_date(F.col("k").cast("int")) if kind == "date" else F.col("k").cast(kind)
    frames = lambda d: d.select(key.alias("who"), F.timestamp_micros("us").alias("ts"), "frame")
    source, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    for k in range(0, len(rows), 2000):
        spark.createDataFrame(rows[k : k + 2000], "k long, us long, frame long").coalesce(1).write.mode("append").parquet(source)
        events = frames(spark.readStream.schema("k long, us long, frame long").option("maxFilesPerTrigger", 1).parquet(source))
        changes = ordered.ordered_changes(events, "who", "ts", "frame", "10 minutes", idle, **more)
        q = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        # one row of state a shard, however many keys there are
        assert 0 < q.lastProgress.stateOperators[0].numRowsTotal <= more.get("shards", 1024)
    end = (max(r[1] for r in rows) // 1000 - 600_000) * 1000
    batch = frames(spark.createDataFrame(rows, "k long, us long, frame long"))
    want = ordered.ordered_changes(batch, "who", "ts", "frame", "10 minutes", idle).filter(F.unix_micros("ts") <= end)
    got = spark.read.parquet(out)
    assert dict(got.dtypes) == {"who": "bigint" if kind == "long" else kind, "ts": "timestamp", "frame": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_idle_keys_with_nothing_waiting_are_forgotten(spark, tmp_path, rocksdb):
    start = 1_700_000_000
    rows = [("a", start, 1), ("b", start + 500, 1), ("b", start + 3000, 1), ("b", start + 6000, 2), ("a", start + 6100, 1), ("b", start + 9000, 2)]
    source = str(tmp_path / "in")
    for r in rows:
        spark.createDataFrame([r], "who string, at long, frame long").coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema("who string, at long, frame long").option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_seconds("at"))
    changes = ordered.ordered_changes(events, "who", "ts", "frame", "1 second", idle_seconds=1000)
    q = changes.writeStream.format("memory").queryName("forgotten_keys").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start()
    q.awaitTermination()
    got = sorted((r.who, int(r.ts.timestamp()) - start) for r in spark.table("forgotten_keys").collect())
    assert got == [("a", 0), ("a", 6100), ("b", 500), ("b", 3000), ("b", 6000)]
    assert q.lastProgress.stateOperators[0].numRowsTotal == 1  # b's; a is forgotten, and its shard with it
