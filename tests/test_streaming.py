import json

import pytest
from pyspark.sql import functions as F

from lodestrata.sources.store import Store
from lodestrata.streaming import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_the_newest_version_of_a_batch_counts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    schema = "source string, version int, text string"

    def run():
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
        jobs.ingest(stream, store, f"file://{tmp_path}/cp", lambda d: d.select("source", "user_id", "text"), order="version", user="u1").awaitTermination()
        return sorted(map(tuple, store.read("chunks").select("user_id", "source", "text").collect()))

    drop(tmp_path / "in", "a.json", [{"source": "s", "version": 2, "text": "second"}, {"source": "s", "version": 1, "text": "zfirst"}, {"source": "t", "version": 1, "text": "other"}])
    assert run() == [("u1", "s", "second"), ("u1", "t", "other")]
    drop(tmp_path / "in", "b.json", [{"source": "s", "version": 3, "text": "third"}])
    assert run() == [("u1", "s", "third"), ("u1", "t", "other")]


def test_session_memory_goes_on_over_runs(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []

    def run():
        out.clear()
        stream = spark.readStream.schema("session_id long, seq long, text string, document string").json(f"file://{tmp_path}/in")
        memory = jobs.session_memory(stream, limit=20)
        query = memory.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r[0]: r[1:] for r in out}

    try:
        drop(tmp_path / "in", "a.json", [{"session_id": 1, "seq": 2, "text": "and  more", "document": None}, {"session_id": 1, "seq": 1, "text": "hello", "document": "d1"}, {"session_id": 2, "seq": 1, "text": None, "document": None}])
        assert run() == {1: (2, "hello and more", "d1", False), 2: (1, "", None, False)}
        drop(tmp_path / "in", "b.json", [{"session_id": 1, "seq": 2, "text": "again", "document": None}, {"session_id": 1, "seq": 3, "text": "the end of it", "document": "d2"}])
        assert run() == {1: (3, "llo and more the end of it"[-20:].strip(), "d2", False)}
    finally:
        spark.conf.set(PROVIDER, before)


def test_windows_leave_late_events_out(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:{m:02d}:00", "event_type": "a", "value": 1.0} for m in (1, 4, 31)]
    drop(tmp_path / "in", "a.json", rows)
    out = []

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(f"file://{tmp_path}/in")
        query = jobs.windowed(stream, "10 minutes").writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend((r.n, r.total) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert out == [(2, 2.0)]
    drop(tmp_path / "in", "b.json", [{"ts": "2024-01-01T00:05:00", "event_type": "a", "value": 9.0}, {"ts": "2024-01-01T01:00:00", "event_type": "a", "value": 1.0}])
    run()
    assert out == [(2, 2.0), (1, 1.0)]  # the late one isn't counted


def test_sessions_by_gap(spark):
    rows = [("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 3, 20)]
    df = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in jobs.sessionised(df, "5 minutes").collect()) == [1, 2]
