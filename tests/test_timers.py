"""Streams with timers and expiring state against their batch forms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.streaming import awareness, timers, watch

EVENTS = "file_path string, event_id long, kind string, ts timestamp"


@pytest.fixture
def rocks(spark):
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _drain(stream, out, checkpoint, **trigger):
    q = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended
    return q


def test_debounce_fires_like_the_batch(rocks, tmp_path):
    """Events in random order within the watermark's delay, in several batches; when all has fired no state is left."""
    spark, r, rows = rocks, random.Random(7), []
    for i in range(90):
        second = r.randint(0, 600)
        rows.append((f"f{r.randrange(4)}", i, r.choice(["change", "change", "add", "unlink"]), second, second + r.randint(0, 25)))
    rows.sort(key=lambda x: x[4])  # as they arrive, up to 25 s late
    for part in range(3):
        some = [x[:4] for x in rows[part * 30 : part * 30 + 30]]
        spark.createDataFrame(some, "file_path string, event_id long, kind string, s long").selectExpr("file_path", "event_id", "kind", "timestamp_seconds(1700000000 + s) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    spark.createDataFrame([("end", 1000, "change", 9999)], "file_path string, event_id long, kind string, s long").selectExpr("file_path", "event_id", "kind", "timestamp_seconds(1700000000 + s) AS ts").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").withWatermark("ts", "30 seconds")
    q = _drain(timers.debounce_stream(events, "file_path", 12), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((x["event_id"], x["action"]) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = spark.read.schema(EVENTS).parquet(f"{tmp_path}/in/*").filter("file_path <> 'end'")
    assert got == sorted((x["event_id"], x["action"]) for x in watch.debounce_unlink(batch, "file_path", 12).collect())
    assert {a for _, a in got} == {"indexed", "removed"}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # the last event alone is open


def test_sessions_are_labelled_like_the_batch_and_forgotten(rocks, tmp_path):
    spark, r, rows = rocks, random.Random(3), []
    for s in range(4):
        for i in range(80):
            sync = r.random() < 0.04
            rows.append((s, len(rows), i, "sync" if sync else r.choice("abcd"), str(r.randint(0, 9)) if r.random() > 0.1 else None, sync))
    calls = spark.createDataFrame(rows, "session long, event_id long, s long, tool string, target string, is_sync boolean").selectExpr("session", "event_id", "timestamp_seconds(1700000000 + s) AS ts", "tool", "target", "is_sync")
    source = spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in/*")
    key = lambda df: sorted((x["event_id"], x["total"], x["novel"], x["state"]) for x in df.collect())
    for part, some in enumerate(("< 1700000040", ">= 1700000040")):  # the second run goes on from the first one's checkpoint
        calls.filter(f"unix_seconds(ts) {some}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        _drain(timers.label_sessions(source), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)  # time to live keeps a stream going for good
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(awareness.label_calls(calls))
    _drain(timers.label_sessions(source, ttl_ms=1000), f"{tmp_path}/short", f"{tmp_path}/cp2", once=True)
    time.sleep(2)
    calls.limit(1).withColumn("session", F.lit(99).cast("long")).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    q = _drain(timers.label_sessions(source, ttl_ms=1000), f"{tmp_path}/short", f"{tmp_path}/cp2", once=True)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 20  # nothing of the first sessions
