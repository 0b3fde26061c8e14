import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.engine import Engine
from lodestrata.operators import chunking
from lodestrata.plans import structure_queries

words = st.text("ab .;,\n|", max_size=120)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(1, 12), st.integers(0, 6))
def test_split_keeps_every_token_within_the_budget(value, size, overlap):
    whole = chunking._TOKEN.findall(value)
    pieces = chunking.split_text(value, size, overlap)
    assert all(1 <= chunking.count_tokens(p) == n <= size or n == 0 for p, n in pieces)
    seen = 0  # each piece goes on from where the one before ended, or up to ``overlap`` tokens earlier
    for p, _ in pieces:
        own = chunking._TOKEN.findall(p)
        starts = [k for k in range(max(0, seen - overlap), seen + 1) if whole[k : k + len(own)] == own and k + len(own) >= seen]
        assert starts
        seen = max(k + len(own) for k in starts)
    assert seen == len(whole) or not pieces
    if not overlap:
        assert [t for p, _ in pieces for t in chunking._TOKEN.findall(p)] == whole


def test_split_prefers_coarse_separators():
    value = "one two three. four five six\n\nseven eight nine ten"
    assert [p for p, _ in chunking.split_text(value, 7)] == ["one two three. four five six", "seven eight nine ten"]
    assert [p for p, _ in chunking.split_text("a b c d e f", 4, 2)] == ["a b c d", "c d e f"]


def brute(rows, child, overlap, parent):
    """Lists of (parent text, [child texts]) of one section, block by block."""

    def packed(blocks, size, lap):
        out, held = [], []
        for page, kind, value in blocks:
            n = chunking.count_tokens(value)
            if held and (kind == "table" or n > size or sum(chunking.count_tokens(b[2]) for b in held) + n > size):
                out.append((held, False))
                held = []
            if kind == "table":
                out.append(([(page, kind, value)], True))
            elif n > size:
                out += [([(page, kind, p)], False) for p, _ in chunking.split_text(value, size, lap)]
            else:
                held.append((page, kind, value))
        return out + ([(held, False)] if held else [])

    join = lambda blocks: "\n".join(b[2] for b in blocks).strip()
    return [(join(p), min(b[0] for b in p), max(b[0] for b in p), [(join(c), min(b[0] for b in c), max(b[0] for b in c)) for c, _ in ([(p, True)] if table else packed(p, child, overlap))]) for p, table in packed(rows, parent, 0)]


def test_chunks_against_brute_force(spark):
    rng = random.Random(3)
    rows, want_parents, want_children = [], {}, {}
    for doc in ("a", "b", "c"):
        parents, children = [], []
        for section in range(4):
            own = []
            for k in range(rng.randint(0, 12)):
                kind = rng.choice(["paragraph"] * 4 + ["table"])
                body = "| x | y |\n" * rng.randint(1, 20) if kind == "table" else " ".join(rng.choice(["word.", "other", "more;"]) for _ in range(rng.randint(1, rng.choice([8, 90]))))
                own.append((k // 3, kind, body.strip()))
                rows.append((doc, section, k, *own[-1]))
            for body, a, b, inner in brute(own, 12, 4, 40):
                parents.append((section, body, a, b))
                children += [(section, len(parents) - 1, c, x, y) for c, x, y in inner]
        want_parents[doc], want_children[doc] = parents, children
    df = spark.createDataFrame(rows, "doc string, section int, block_no int, page int, kind string, line string").repartition(5)
    parents, children = chunking.chunks(df, "doc", "section", "block_no", 12, 4, 40)
    for doc in want_parents:
        assert [(r.section, r.text, r.page, r.page_end) for r in parents.filter(F.col("doc") == doc).orderBy("parent_index").collect()] == want_parents[doc]
        got = children.filter(F.col("doc") == doc).orderBy("chunk_index").collect()
        assert [(r.section, r.parent_index, r.text, r.page, r.page_end) for r in got] == want_children[doc]
        assert [r.chunk_index for r in got] == list(range(len(got)))
        assert [r.prev_index for r in got] == [None, *range(len(got) - 1)][: len(got)] and [r.next_index for r in got] == [*range(1, len(got)), None][-len(got) :]


def test_lines_to_blocks(spark):
    lines = [(1, 1, "a"), (2, 1, "| x |"), (3, 1, "| y |"), (4, 1, " "), (5, 2, "| z |"), (6, 2, "b"), (7, 2, "c")]
    df = spark.createDataFrame([("d", *x) for x in lines], "doc string, n int, page int, line string")
    got = [(r.n, r.page, r.kind, r.line) for r in chunking.blocks_of(df, "doc", "n").orderBy("n").collect()]
    assert got == [(1, 1, "paragraph", "a"), (2, 1, "table", "| x |\n| y |\n| z |"), (6, 2, "paragraph", "b"), (7, 2, "paragraph", "c")]


def test_query_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = structure_queries.parent_child_chunks(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs:
        got = sorted(by.get(d.doc_id, []), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in got] == list(range(len(got))) and all(r.tokens <= 350 or r.has_table for r in got)
        assert len({r.parent_index for r in got}) == (got[-1].parent_index + 1 if got else 0)
        said = " ".join(chunking._TOKEN.findall("\n".join(r.text for r in got)))
        for line in d.text.split("\n"):
            tokens = chunking._TOKEN.findall(line)
            if 0 < len(tokens) <= 350:
                assert " ".join(tokens) in said


def test_engine_keeps_parents_and_its_index(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "u1")
    body = lambda word: "\n".join(f"Line {k} about the {word} of the house." for k in range(200))
    pages = spark.createDataFrame([("s1", 1, body("roof")), ("s2", 1, body("cellar")), ("s2", 2, "The attic is dry.")], "source string, page int, text string")
    engine.ingest(pages)
    chunks, parents = engine._table("chunks"), engine._table("parents")
    assert chunks.join(parents, ["source", "parent_id"]).count() == chunks.count() > parents.count()
    asked = spark.createDataFrame([(1, "roof house"), (2, "attic")], "query_id int, text string")
    found = lambda: {(r.query_id, r.source) for r in engine.index.search(asked, 5).join(engine._table("chunks").select("chunk_id", "source"), "chunk_id").collect()}
    assert {s for q, s in found() if q == 2} == {"s2"}
    engine.ingest(spark.createDataFrame([("s1", 1, "An attic with a roof."), ("s3", 1, "More about an attic.")], "source string, page int, text string"))
    assert {s for q, s in found() if q == 2} == {"s1", "s2", "s3"}
    engine.delete(["s3"])
    assert {s for q, s in found() if q == 2} == {"s1", "s2"} and engine._table("parents").filter("source = 's3'").count() == 0
    fresh = Engine(spark, f"file://{tmp_path}/none", "u1")
    assert fresh.documents().count() == 0 and fresh.sessions().count() == 0 and fresh.runs().count() == 0 and fresh.messages("x").count() == 0
    assert [(r.action, r.answer[:12]) for r in fresh.ask(asked).collect()] == [("refused", "I don't know")] * 2


def test_children_are_packed_once(spark):
    """Parents and children are numbered in one pass over what was packed."""
    rows = [(d, s, b, 1, "paragraph", f"w{b} " * (1 + b % 7)) for d in range(3) for s in range(3) for b in range(20)]
    blocks = spark.createDataFrame(rows, "doc long, section int, block int, page int, kind string, line string")
    parents, children = chunking.chunks(blocks, "doc", "section", "block", child=9, overlap=2, parent=25)
    assert children._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    held = {(r.doc, r.section, r.parent_index) for r in parents.collect()}
    got = children.collect()
    assert {(r.doc, r.section, r.parent_index) for r in got} == held
    for d in range(3):
        assert sorted(r.parent_index for r in parents.collect() if r.doc == d) == list(range(sum(h[0] == d for h in held)))
        own = sorted((r.chunk_index, r.section, r.parent_index, r.prev_index, r.next_index) for r in got if r.doc == d)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:3] for x in own] == sorted(x[1:3] for x in own)
        assert [x[3:] for x in own] == [(k - 1 if k else None, k + 1 if k + 1 < len(own) else None) for k in range(len(own))]
