import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import numbers
from lodestrata.operators import rank, vectors
from lodestrata.operators.postings import Counted, Postings
from lodestrata.operators.vectors import VectorIndex
from lodestrata.plans import catalog

SCHEMA = "source string, chunk_id long, text string, topics string"


def chunks(spark, n=60, seed=1, sources=12):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)] + ["the", "E-01", "Policy"]
    return [(f"s{k % sources}", k, "the " + " ".join(rng.choice(words, rng.integers(0, 30))), f"topic{k % 5}") for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


QUESTIONS = [(1, "the w1 w2 w2"), (2, "policy E-01 unknown"), (3, "topic3 w9"), (4, ""), (5, "nothing known")]


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score").collect()))


def test_index_scores_as_a_scan_does(spark, tmp_path):
    df = frame(spark, chunks(spark))
    index = Postings(spark, f"file://{tmp_path}", folders=8).build(df)
    want = rows(rank.bm25_scores(df, asked(spark), "chunk_id"))
    assert want and rows(index.scores(asked(spark))) == want
    best = index.search(asked(spark), 3)
    assert {r.rank for r in best.collect()} <= {1, 2, 3}


def test_counted_chunks_score_as_the_index_does(spark, tmp_path):
    """A batch of questions is scored from the counted rows: no posting is dealt by term. Chunks of one key are brought together."""
    df = frame(spark, chunks(spark))
    for n, rows_ in enumerate((df, df.union(df.filter("chunk_id < 9").withColumn("text", F.concat(F.lit("the w1 "), "text"))))):
        counted, index = (kind(spark, f"file://{tmp_path}/{kind.__name__}{n}", folders=4).build(rows_) for kind in (Counted, Postings))
        assert counted.exists() and counted.weights() == pytest.approx(index.weights())
        assert (counted.store.read("postings") is None) == (n == 0)
        assert rows(counted.search(asked(spark), 5)) == rows(index.search(asked(spark), 5))
        assert rows(counted.scores(asked(spark))) == rows(index.scores(asked(spark)))


def test_labels_find_but_are_not_text(spark, tmp_path):
    df = frame(spark, chunks(spark))
    index = Postings(spark, f"file://{tmp_path}", folders=8).build(df, labels=["topics"])
    with_labels = df.withColumn("text", F.concat_ws(" ", "text", "topics"))
    assert rows(index.scores(asked(spark))) == rows(rank.bm25_scores(with_labels, asked(spark), "chunk_id"))
    assert any(r[0] == 3 for r in rows(index.scores(asked(spark))))


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Added, replaced and deleted documents, then a compaction."""
    now = chunks(spark)
    index = Postings(spark, f"file://{tmp_path}/a", folders=8).build(frame(spark, now))
    steps = [
        ([("s99", 900 + k, f"the w1 fresh{k} w{k}", "t") for k in range(4)], []),
        ([("s3", 700, "the replaced w2 w2", "t"), ("s98", 701, "also new", "t")], ["s3"]),
        ([], ["s1", "s99"]),
        ([("s5", 5, "", "t")], ["s5"]),
    ]
    for step, (new, gone) in enumerate(steps):
        old = [r for r in now if r[0] in gone]
        now = [r for r in now if r[0] not in gone] + new
        index.update(frame(spark, new), frame(spark, old))
        built = Postings(spark, f"file://{tmp_path}/b{step}", folders=8).build(frame(spark, now))
        assert rows(index.scores(asked(spark))) == rows(built.scores(asked(spark))) == rows(rank.bm25_scores(frame(spark, now), asked(spark), "chunk_id"))
        state = lambda x: (sorted(map(tuple, x.store.read("terms").select("term", "df").collect())), x.weights()[:2])
        assert state(index) == state(built)
    before = rows(index.scores(asked(spark)))
    index.compact()
    assert rows(index.scores(asked(spark))) == before


def test_an_empty_index_and_a_first_update(spark, tmp_path):
    empty = frame(spark, [])
    index = Postings(spark, f"file://{tmp_path}")
    assert not index.exists()
    index.update(empty, empty)
    assert index.exists() and rows(index.scores(asked(spark))) == []
    some = chunks(spark, 5)
    index.update(frame(spark, some), empty)
    assert rows(index.scores(asked(spark))) == rows(rank.bm25_scores(frame(spark, some), asked(spark), "chunk_id"))


def test_a_question_reads_its_folders_only(spark, tmp_path):
    index = Postings(spark, f"file://{tmp_path}", folders=16).build(frame(spark, chunks(spark)))
    found = index.postings_of(spark.createDataFrame([("w1",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "EqualTo(term,w1)" in plan
    folders = {re.search(r"folder=(\d+)", f)[1] for f in found.inputFiles()}
    assert {r.term for r in found.collect()} == {"w1"} and len(folders) > 0
    many = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    assert {r.term for r in index.postings_of(many).select("term").distinct().collect()} == {f"w{k}" for k in range(40)}


# ---------------------------------------------------------------- vectors


def test_recall_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        found, exact = catalog.QUERIES["ann_topk"](spark, f"/root/testdata/{sf}"), catalog.QUERIES["knn_topk_cosine"](spark, f"/root/testdata/{sf}")
        per = vectors.recall(found, exact, "vec_id").collect()
        assert len(per) == exact.select("query_id").distinct().count()
        assert sum(r.recall for r in per) / len(per) >= 0.9


def test_fewer_cells_are_read_where_vectors_lie_in_heaps(spark, tmp_path):
    rng = np.random.default_rng(2)
    heaps = rng.normal(size=(30, 16))
    x = heaps[rng.integers(0, 30, 4000)] + rng.normal(0, 0.08, (4000, 16))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "chunk_id long, embedding array<float>")
    index = VectorIndex(spark, f"file://{tmp_path}").build(df, cells=30)
    questions = df.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = index.store.read("cells").first().probes
    assert probes <= 6
    per = vectors.recall(index.search(questions, 10), rank.knn(df, questions, "chunk_id", 10), "chunk_id").collect()
    assert np.mean([r.recall for r in per]) >= 0.9
    whole = index.search(questions, 10, probes=30)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rank.knn(df, questions, "chunk_id", 10).collect()))
    one = questions.limit(1)
    assert index.probed(one).count() == probes
    plan = index.store.read("vectors").filter(F.col("cell").isin([1, 2]))
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan._jdf.queryExecution().executedPlan().toString())


def test_cells_are_searched_in_blocks(spark, tmp_path):
    """No row is made for a pair; of equal distances the smaller key stays; vectors that can't be measured are near to none."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(500, 8)), 3, axis=0)
    rows_ = [(int(k), [float(v) for v in x[j]]) for j, k in enumerate(rng.permutation(1500))] + [(1600, [0.0] * 8), (1601, [1.0, 2.0])]
    df = spark.createDataFrame(rows_, "chunk_id long, embedding array<float>").filter("size(embedding) = 8")
    index = VectorIndex(spark, f"file://{tmp_path}").build(df, cells=12)
    questions = spark.createDataFrame([(f"q{k}", v) for k, v in rows_[:300]] + [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("none", None)], "query_id string, vector array<float>")
    found = index.search(questions, 4, probes=12)
    assert "Join [cell" not in found._jdf.queryExecution().analyzed().toString() and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rank.knn(df, questions, "chunk_id", 4).collect()))
    # few probes: what brute force finds within the probed cells
    near = index.probed(questions, 2).join(index.store.read("vectors"), "cell").join(questions.withColumnRenamed("vector", "v"), "query_id")
    want = rank.top(near.select("query_id", "chunk_id", (F.round(numbers.cosine_distance(F.col("vector"), F.col("v")), 6) + 0.0).alias("distance")).filter("distance IS NOT NULL"), ["query_id"], ["distance", "chunk_id"], 4)
    assert sorted(map(tuple, index.search(questions, 4, probes=2).collect())) == sorted(map(tuple, want.collect()))


def test_every_vector_is_filed_once(spark, tmp_path):
    rows_ = [(k, [float(k % 3), 1.0]) for k in range(50)] + [(90, None), (91, []), (92, [0.0, 0.0])]
    df = spark.createDataFrame(rows_, "chunk_id long, embedding array<float>")
    index = VectorIndex(spark, f"file://{tmp_path}").build(df)
    assert sorted(r.chunk_id for r in index.store.read("vectors").collect()) == [*range(50), 92]
    empty = VectorIndex(spark, f"file://{tmp_path}/e").build(df.limit(0))
    question = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<float>")
    assert empty.exists() and empty.search(question, 3).count() == 0
    assert index.search(question, 3).count() == 3


@pytest.mark.parametrize("cells", [1, 4])
def test_centres_are_of_unit_length_and_serve_all(cells):
    x = np.random.default_rng(3).normal(size=(40, 5))
    centres = vectors.fit(x, cells)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    assert 1 <= vectors.probes_for(x, centres) <= cells
