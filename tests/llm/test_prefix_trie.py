import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import common, prefix_trie, queries, scan

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(convs):
    """Every prefix of every conversation, one at a time."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for path, of in members.items():
        below = [q for q in members if q[: len(path)] == path]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        ends = sorted(c for c in of if len(convs[c]) == len(path))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        rows.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), sum(len(q) == len(path) + 1 for q in below), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(turns_of(rows))
    turns, members = prefix_trie.replanted(prefix_trie.ordered_turns(df))
    assert rows_of(prefix_trie.trie(turns, members)) == brute(rebuilt(turns_of(rows)))


def test_table_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check(spark, [tuple(r) for r in rows])


def test_defined_cases(spark):
    rows = [
        (100, None, "user", "a"), (100, 1, "user", "b"), (100, 1, None, "b"), (100, 2, "user", None),
        (101, 1, "user", "a"), (101, 1, "user", "a"), (102, None, None, None), (103, 5, "user", "x\U0001f600y"),
        (205, 1, "user", "alone"), (None, 1, "user", "nowhere"), (-5, 1, "user", "a"), (0, 1, "user", "a"), (7, 1, "user", "z" * 50_000), (7, 2, "user", "a"),
    ]
    check(spark, rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_long_conversations_and_hot_keys(spark, monkeypatch):
    """Many equal conversations, one of 300 turns, one that shares 130 of them, a common first turn."""
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(3)]
    rows += [(1, t, "user", f"long {t}") for t in range(300)] + [(2, t, "user", f"long {t if t < 130 else -t}") for t in range(140)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c % 7} {t}") for c in range(3000, 3060) for t in range(1 + c % 3)]
    rows += [(4, t, "user", f"long {t}") for t in range(64)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(turns_of(rows))
    assert rows_of(prefix_trie.prefix_trie(df)) == want
    monkeypatch.setattr(common.looked_up, "__defaults__", (5,))
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    assert rows_of(prefix_trie.prefix_trie(df)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(prefix_trie.prefix_trie(df)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_intervals_nest(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = prefix_trie.prefix_trie(df).orderBy("preorder").collect()
    assert [r.preorder for r in rows] == list(range(1, len(rows) + 1))
    open_ends = []
    for r in rows:
        while open_ends and open_ends[-1] < r.preorder:
            open_ends.pop()
        assert len(open_ends) == r.depth and r.preorder <= r.subtree_end and all(e >= r.subtree_end for e in open_ends)
        open_ends.append(r.subtree_end)


def test_query_is_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert out.columns == COLUMNS and rows_of(out) == brute(rebuilt(turns_of(rows)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 9)), max_size=40))
def test_running_sums(spark, values):
    df = spark.createDataFrame([(s, k, v) for k, (s, v) in enumerate(values)], "s long, k long, v long").repartition(3)
    got = sorted(map(tuple, scan.scan(df, ["s", "k"], ["k"], runs={"r": "v"}, totals={"t": "v"}, segment="s").collect()))
    want, total, run, last = [], 0, 0, None
    for s, k, v in sorted((s, k, v) for k, (s, v) in enumerate(values)):
        total, run, last = total + v, (run if s == last else 0) + v, s
        want.append((k, run, total))
    assert got == sorted(want)


def test_one_segment_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select((F.col("id") >= 1990).cast("long").alias("s"), "id", F.lit(1).alias("one"))
        got = {r.id: (r.r, r.t) for r in scan.scan(df, ["s", "id"], ["id"], runs={"r": "one"}, totals={"t": "one"}, segment="s").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: (k + 1 if k < 1990 else k - 1989, k + 1) for k in range(2000)}


@pytest.mark.parametrize("name", ["node", "conv", "depth", "place", "_key"])
def test_clashing_columns(spark, name):
    rows = [(1, 1, "user", "a"), (2, 1, "user", "a"), (2, 2, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(name, F.lit("x"))
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(turns_of(rows))
