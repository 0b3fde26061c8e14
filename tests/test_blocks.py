"""The best rows of many questions, held against plain Python; no row is made for a pair of question and row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import blocks, rank


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_hand(vectors, asked, k):
    out = []
    for q, v in asked:
        near = []
        for key, x in vectors:
            if x is None or None in x or len(x) != len(v):
                continue
            dot = na = nb = 0.0
            for a, b in zip(x, v, strict=True):
                dot, na, nb = dot + a * b, na + a * a, nb + b * b
            if na and nb:
                near.append((round(1 - dot / (math.sqrt(na) * math.sqrt(nb)), 6) + 0.0, key))
        out += [(q, key, d, n + 1) for n, (d, key) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(f"k{n:05d}", [float(x) for x in rng.normal(size=4).astype(np.float32)]) for n in range(2500)]
    rows += [(f"c{n:05d}", rows[7][1]) for n in range(900)]  # copies: the least keys stay
    return rows + [("n1", None), ("n2", [0.0] * 4), ("n3", [1.0, None, 0.0, 0.0]), ("n4", [1.0, 2.0]), ("n5", [])]


def test_nearest_are_those_of_all_pairs(spark, vectors):
    asked = [(n, vectors[n][1]) for n in range(300)] + [(900, [1.0, 1.0]), (901, [0.0] * 4)]
    found = rank.knn(spark.createDataFrame(vectors, "key string, embedding array<float>"), spark.createDataFrame(asked, "query_id int, vector array<float>"), "key", 5)
    assert sorted(map(tuple, found.select("query_id", "key", "distance", "rank").collect())) == by_hand(vectors, asked, 5)
    assert "explode" not in plan_of(found) and "Generate" not in plan_of(found)


def test_late_interaction_over_parts_of_any_number(spark):
    rng = np.random.default_rng(4)
    parts = lambda n: [[float(x) for x in rng.normal(size=3)] for _ in range(n)]
    items = [(n, parts(1 + n % 4)) for n in range(1500)] + [(5000, [])]
    asked = [(n, parts(1 + n % 3)) for n in range(20)]
    found = rank.max_sim(spark.createDataFrame(items, "key long, parts array<array<double>>"), spark.createDataFrame(asked, "query_id int, parts array<array<double>>"), "key", 4)
    score = lambda q, p: sum(max(sum(a * b for a, b in zip(x, y, strict=True)) for y in p) for x in q)
    want = []
    for q, v in asked:
        best = sorted((-round(score(v, p), 6), key) for key, p in items if p)[:4]
        want += [(q, key, -s, n + 1) for n, (s, key) in enumerate(best)]
    assert sorted(map(tuple, found.select("query_id", "key", "score", "rank").collect())) == sorted(want)
    assert "Generate" not in plan_of(found)


def test_rounding_is_that_of_the_columns(spark):
    x = np.array([0.0000005, 0.1234565, -0.1234565, 1.0000015, 0.4999995, 2.5, -0.0000001, 12.3456785, 0.1 + 0.2])
    want = [r[0] + 0.0 for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert blocks.rounded(x).tolist() == want


def test_tokens_of_an_index_are_those_of_the_columns(spark):
    import pyarrow as pa

    from lodestrata.functions import text
    from lodestrata.operators.postings import _words

    texts = ["", "a-b--c -d e- f", "-", "é-x y", "x-", "-y", "Straße 12-3-ab", "a\u0130b", "1", "--", "tail", "head", "日本 a1-b2"]
    rows = [r for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", F.lower("t").alias("w"), text.bm25_tokens(F.col("t")).alias("x")).orderBy("n").collect()]
    for low in (0, 3):  # a slice too
        sizes, words = _words(pa.array([r.w for r in rows]).slice(low))
        assert sizes.tolist() == [len(r.x) for r in rows[low:]] and words.to_pylist() == [w for r in rows[low:] for w in r.x]


def test_many_questions_find_what_a_scan_finds(spark, tmp_path):
    from lodestrata.operators.postings import Postings

    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(60)]
    rows = [(n % 400, f"s{n % 400 % 7}", "the " + " ".join(rng.choice(words, rng.integers(0, 25)) if n % 3 else words[:4])) for n in range(420)]  # copies, and keys that come twice
    docs = spark.createDataFrame(rows, "chunk_id long, source string, text string")
    asked = spark.createDataFrame([(n, " ".join(rng.choice([*words, "the", "none"], rng.integers(0, 9)))) for n in range(300)], "query_id int, text string")
    found = Postings(spark, f"file://{tmp_path}").build(docs).search(asked, 6)
    want = rank.top(rank.bm25_scores(docs, asked, "chunk_id"), ["query_id"], [F.desc("score"), "chunk_id"], 6)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "score", "rank").collect()))
    assert "Aggregate [query_id" not in plan_of(found)  # no row for a pair of question and chunk


def test_a_name_that_many_rows_share_is_counted_before_it_is_asked_for(spark):
    from lodestrata.operators import facts

    cells = spark.createDataFrame([("a", "size", str(n)) for n in range(50)] + [("b", "size", "7")], "entity_norm string, column_norm string, value string")
    probes = spark.createDataFrame([(n, "abc"[n % 3], "size") for n in range(60)], "query_id int, entity_norm string, column_norm string")
    found = facts.lookup(probes, cells)
    want = {"a": ("ambiguous", None, 50), "b": ("confident", "7", 1), "c": ("empty", None, 0)}
    assert {r.query_id: (r.verdict, r.value, r.n_rows) for r in found.collect()} == {n: want["abc"[n % 3]] for n in range(60)}
    assert plan_of(found).index("LeftOuter") < plan_of(found).index("count(value")


def test_a_long_table_is_packed_row_by_row(spark):
    from lodestrata.operators import structure

    rng = np.random.default_rng(6)
    rows = [(n % 3, n, int(size)) for n, size in enumerate(rng.integers(0, 40, 3000))]
    found = structure.packed(spark.createDataFrame(rows, "part int, o int, tokens int"), ["part"], ["o"], "tokens", 60, 4)
    want = []
    for part in range(3):
        group = used = count = 0
        for p, o, size in rows:
            if p == part:
                if count and (used + size > 60 or count >= 4):
                    group, used, count = group + 1, 0, 0
                used, count = used + size, count + 1
                want.append((part, o, group))
    assert sorted((r.part, r.o, r.chunk_no) for r in found.collect()) == sorted(want)
