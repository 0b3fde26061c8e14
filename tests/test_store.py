import threading

from pyspark.sql import functions as F

from lodestrata.engine import Engine
from lodestrata.sources.store import Store


def rows(df):
    return sorted(tuple(r) for r in df.select("user_id", "source", "n").collect())


def make(spark, values):
    return spark.createDataFrame(values, "user_id string, source string, n int")


def test_replace_delete_and_compact(spark, tmp_path):
    store, by = Store(spark, f"file://{tmp_path}"), ["user_id", "source"]
    assert store.read("t") is None
    store.replace("t", make(spark, [("u", "a", 1), ("u", "a", 2), ("v", "a", 3)]), by)
    seen = store.read("t")
    store.replace("t", make(spark, [("u", "a", 9)]), by, also=make(spark, [("v", "a", 0)]))
    assert rows(store.read("t")) == [("u", "a", 9)]
    assert len(rows(seen)) == 3  # a reader keeps what it began with
    store.replace("t", make(spark, [("v", "b", 4)]), by)
    store.compact("t")
    assert rows(store.read("t")) == [("u", "a", 9), ("v", "b", 4)]
    store.delete("t", make(spark, [("v", "b", 0)]), by)
    assert rows(store.read("t")) == [("u", "a", 9)]
    store.write("t", make(spark, [("w", "z", 1)]))
    assert rows(store.read("t")) == [("w", "z", 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    writers = [threading.Thread(target=lambda k=k: store.replace("t", make(spark, [("u", f"s{k}", k)]), ["user_id", "source"])) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert rows(store.read("t")) == [("u", f"s{k}", k) for k in range(4)]


def test_sessions_belong_to_their_user(spark, tmp_path):
    mine, other = Engine(spark, f"file://{tmp_path}", "u1"), Engine(spark, f"file://{tmp_path}", "u2")
    a, b = mine.start_session("first"), mine.start_session("second")
    said = [(a, 1, "user", "hello"), (a, 2, "assistant", "yes"), (b, 1, "user", "x")]
    mine.say(spark.createDataFrame(said, "session_id string, seq int, role string, content string"))
    other.start_session("theirs")
    other.say(spark.createDataFrame([(a, 3, "user", "intrusion")], "session_id string, seq int, role string, content string"))
    assert [r.content for r in mine.messages(a).orderBy("position").collect()] == ["hello", "yes"]
    assert mine.sessions().count() == 2 and other.sessions().count() == 1
    mine.remember(a, summary="greeting")
    mine.remember(a, last_document="d1")
    kept = mine._table("sessions").filter(F.col("session_id") == a).first()
    assert (kept.summary, kept.last_document) == ("greeting", "d1")
    mine.end_session(a)
    assert mine.sessions().count() == 1 and mine._table("messages").count() == 1


def test_runs_are_scored_and_listed(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "u1")
    results = spark.createDataFrame(
        [("q1", "plain", 0.9, False, True, None, None, None), ("q2", "plain", 0.9, False, False, None, None, None), ("q3", "gone", 0.1, True, None, None, None, None)],
        "id string, category string, similarity double, refused boolean, exact boolean, complete boolean, table_ok boolean, stable boolean",
    )
    modes = spark.createDataFrame([("gone", "refusal")], "category string, mode string")
    run = engine.record_run(results, modes)
    assert engine.runs().first().run_id == run
    assert {(r.category, r.n_passed) for r in engine.by_category().collect()} == {("plain", 1), ("gone", 1)}
    assert [r.id for r in engine.failures(run).collect()] == ["q2"]
    engine.delete_run(run)
    assert engine.runs().count() == 0


def _rows(df):
    df = df.select(*[c for c in ("user_id", "k", "v") if c in df.columns])
    return sorted(map(tuple, df.collect()))


def test_a_delta_committed_during_compaction_stays_in_force(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame(rows, "user_id string, k string, v int")
    store.write("t", frame([("u", "a", 1), ("u", "b", 2), ("u", "c", 3)]))
    store.replace("t", frame([("u", "b", 5)]), ["user_id", "k"])
    save, busy = store._save, []

    def meanwhile(name, df, kind):
        folder = save(name, df, kind)
        if not busy:
            busy.append(True)
            store.replace("t", frame([("u", "a", 9)]), ["user_id", "k"])
            store.delete("t", frame([("u", "c", 0)]).select("user_id", "k"), ["user_id", "k"])
        return folder

    store._save = meanwhile
    store.compact("t")
    store._save = save
    assert _rows(store.read("t")) == [("u", "a", 9), ("u", "b", 5)]
    store.compact("t")
    assert _rows(store.read("t")) == [("u", "a", 9), ("u", "b", 5)] and len(store._commits("t")) == 1


def test_a_torn_commit_is_passed_over(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.createDataFrame([("u", 1)], "user_id string, v int"))
    (tmp_path / "t" / "_log" / "000000000002.json").write_text('{"kind": "del')
    assert _rows(store.read("t")) == [("u", 1)]
    store.replace("t", spark.createDataFrame([("u", 2)], "user_id string, v int"), ["user_id"])
    assert _rows(store.read("t")) == [("u", 2)]


def test_vacuum_removes_what_no_reader_needs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for v in range(3):
        store.replace("t", spark.createDataFrame([("u", v)], "user_id string, v int"), ["user_id"])
    assert store.vacuum("t", 1) == 0
    store.compact("t")
    assert store.vacuum("t", 0) > 0
    assert _rows(store.read("t")) == [("u", 2)]
    assert len(list((tmp_path / "t" / "_log").glob("*.json"))) == 1 and len(list((tmp_path / "t" / "rows").iterdir())) == 1
    assert store.vacuum("t", 0) == 0


def test_layout_gives_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": ["bucket"]})
    store.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "bucket int, v string"))
    assert _rows(store.read("t").filter("bucket = 2").select("v")) == [("b",)]
    assert len(store.read("t").filter("bucket = 2").inputFiles()) >= 1 and list((tmp_path / "t" / "rows").rglob("bucket=2"))
