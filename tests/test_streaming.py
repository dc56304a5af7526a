import random

from quillmesh.sources import bindings as b
from quillmesh.streaming import awareness, watch

SF = "/root/testdata/sf0.001"


def _calls(spark):
    r = random.Random(3)
    rows = []
    for s in range(12):
        for i in range(120):
            sync = r.random() < 0.03  # a tool of its own
            rows.append((s, len(rows), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "sync" if sync else r.choice("abcd"), str(r.randint(0, 12)) if r.random() > 0.1 else None, sync))
    return spark.createDataFrame(rows, "session long, event_id long, ts string, tool string, target string, is_sync boolean").selectExpr("session", "event_id", "cast(ts as timestamp) ts", "tool", "target", "is_sync")


def test_states_by_thresholds():
    s = awareness.Session()
    got = [s.call("t", str(i), False) for i in range(18)]
    assert got[:8] == ["explore"] * 8 and got[8:12] == ["synthesize_note"] * 4 and got[12:15] == ["synthesize_warning"] * 3 and got[15:] == ["finalize"] * 3
    assert s.call("t", "0", False) == "cache_hit" and s.call("t", "17", False) == "finalize" and s.total == 18
    assert s.call("sync", None, True) == "sync"


def test_windows_equal_the_automaton(spark):
    calls = _calls(spark)
    want = {}
    sessions = {}
    for x in calls.orderBy("session", "ts", "event_id").collect():
        s = sessions.setdefault(x["session"], awareness.Session())
        label = s.call(x["tool"], x["target"], x["is_sync"])
        want[x["event_id"]] = label
    got = {x["event_id"]: x["state"] for x in awareness.label_calls(calls).collect()}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    calls = b.session_calls(spark, SF).selectExpr("session", "event_id", "cast(ts as timestamp) ts", "tool", "target", "is_sync")
    calls.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = awareness.label_stream(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {x["event_id"]: x["state"] for x in spark.table("labels").collect()}
    assert got == {x["event_id"]: x["state"] for x in awareness.label_calls(calls).collect()}


def test_debounced_stream_equals_batch(spark, tmp_path):
    events = b.table(spark, SF, "events").selectExpr("user_id", "event_id", "cast(ts as timestamp) ts", "event_type kind")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = watch.debounce(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes"), "user_id", "6 hours")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    key = lambda df: sorted((x["user_id"], x["event_id"], x["n"]) for x in df.collect())
    assert key(spark.table("bursts")) == key(watch.debounce(events, "user_id", "6 hours"))


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file_path string, checksum string")
    changes = watch.snapshot_diff(old, new)
    assert sorted(tuple(r) for r in changes.collect()) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    assert not watch.rebuild_needed(changes).first()["rebuild"] and watch.rebuild_needed(changes, asked=True).first()["rebuild"]
    assert not watch.rebuild_needed(changes.limit(0), asked=True).first()["rebuild"]
