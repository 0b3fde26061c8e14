"""Small cases that can be checked by hand."""

import re

import pytest
from pyspark.sql import functions as F

from lodestrata import schema, sqlapi
from lodestrata.config import EngineConfig, profiles
from lodestrata.engine import Engine
from lodestrata.functions import fuzzy, numbers, text
from lodestrata.operators import context, facts, ground, manifest, rank, structure
from lodestrata.scope import MissingScopeError, Scope


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_in_text(spark):
    rows = spark.createDataFrame([("78%",), ("1,200",), ("N/A",), ("-3.5 below",)], "t string")
    assert [r.x for r in rows.select(numbers.leading_number(F.col("t")).alias("x")).collect()] == [78.0, 1200.0, None, -3.5]


def test_interleave_budget_and_round_robin(spark):
    ranks = spark.createDataFrame([(1, k) for k in range(1, 7)], "query_id int, rank int")
    assert [r["rank"] for r in rank.interleave(ranks).orderBy("position").collect()] == [1, 3, 5, 6, 4, 2]
    units = spark.createDataFrame([(1, k, n) for k, n in enumerate([40, 30, 50, 20])], "q int, o int, tokens int")
    assert sorted(r.o for r in context.fill(units, "q", "o", "tokens", 100).collect()) == [0, 1, 3]
    lists = spark.createDataFrame([(1, 0, k + 1, c) for k, c in enumerate("abc")] + [(1, 1, k + 1, c) for k, c in enumerate("ade")], "query_id int, entity_no int, rank int, key string")
    assert [r.key for r in rank.round_robin(lists, "key", 2).orderBy("position").collect()] == ["a", "b", "d"]


def test_gate(spark):
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (1, "c", 0.4)], "query_id int, source string, score double")
    assert [r.source for r in rank.gate(scores).orderBy("rank").collect()] == ["a", "b"]


def test_adjacency_counts_index_zero(spark):
    rows = spark.createDataFrame([("s", k) for k in (0, 1, 4, 5, 7, 10)], "s string, k int")
    runs = context.adjacency(rows, "s", "k").groupBy("run_no").agg(F.array_sort(F.collect_list("k")).alias("ks")).collect()
    assert sorted(r.ks for r in runs) == [[0, 1], [4, 5, 7], [10]]


def test_table_over_a_page_break(spark):
    fragments = spark.createDataFrame([("d", 0, 7, 3, True, True), ("d", 1, 8, 3, True, False)], "doc string, fragment_no int, page int, width int, first_on_page boolean, last_on_page boolean")
    rows = [("d", 0, k, ["Code", "Meaning", "Action"] if k == 0 else [f"E-{k}", "m", "a"]) for k in range(3)]
    rows += [("d", 1, 0, ["code ", "MEANING", "Action"])] + [("d", 1, k, [f"E-{k + 2}", "m", "a"]) for k in range(1, 6)] + [("d", 1, 9, ["", " ", ""])]
    out = structure.stitched_rows(spark.createDataFrame(rows, "doc string, fragment_no int, row_no int, cells array<string>"), fragments, "doc").collect()
    assert len(out) == 7 and {r.table_no for r in out} == {0}


def test_headings(spark):
    rows = [("1. Scope", True), ("Annual Leave Policy", True), ("This is a sentence.", False), ("INTRODUCTION", True), ("Hardware Request P3 03-", False), ("", False), ("notes on things", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", text.is_heading(F.col("t")).alias("x")).collect()
    assert all(r.want == r.x for r in got)


def test_facts_guards(spark):
    assert fuzzy.ratio("abc", "abc") == 100 and fuzzy.weighted_ratio("band salary", "salary band") >= 95
    assert fuzzy.partial_ratio("eng", "english") == 100
    base = spark.createDataFrame([(k, f"Employee {k}", 100 + k) for k in range(1, 91)], "id int, name string, score int")
    cells = facts.cells(base, "staff", "name", {"score": "Score"}, "id", "Staff")
    asked = spark.createDataFrame([(1, "what is the score of employee 45"), (2, "how many scored above 170"), (3, "who has the highest score"), (4, "what is the score of employee 145")], "query_id int, text string")
    got = {r.query_id: r for r in facts.ask(asked, cells).collect()}
    assert (got[1].verdict, got[1].value) == ("confident", "145")
    assert (got[2].kind, got[2].value) == ("count", "20")
    assert (got[3].verdict, got[3].entity) == ("confident", "Employee 90")
    assert got[4].verdict in ("skipped", "empty")
    tie = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "id int, name string, score int")
    probe = spark.createDataFrame([(1, "score", "max")], "query_id int, column_norm string, kind string")
    assert facts.extreme(probe, facts.cells(tie, "t", "name", {"score": "Score"}, "id")).first().verdict == "ambiguous"


def test_coverage_and_head_noun(spark):
    rows = spark.createDataFrame([("Item a", True), ("Item b", True), ("Item c", False)], "item string, want boolean")
    got = rows.select("want", manifest.covers(F.col("item"), F.lit("It has item b and also item a.")).alias("x")).collect()
    assert all(r.want == r.x for r in got)
    assert one(spark, manifest.head_noun(F.lit("list every approval required"))) == "approval"
    assert one(spark, manifest.head_noun(F.lit("types of IT support requests"))) == "request"


def test_claims(spark):
    answer = spark.createDataFrame([(1, "1. Limit is 42\n2. Code E-04 costs 1,300")], "id int, text string")
    held = spark.createDataFrame([(1, "Limit is 42, see E-04")], "id int, text string")
    assert [r.claim for r in ground.unsupported(answer, held, "id").collect()] == ["1300"]
    assert ground.prune(answer, ground.unsupported(answer, held, "id"), "id").first().text == "1. Limit is 42"
    assert one(spark, text.is_refusal(F.lit("**I don't know based on the available documents.**")))


def test_contract_and_scope(spark):
    df = schema.apply_defaults(spark.createDataFrame([(1, "a, b", "letter")], "id int, topics string, content_type string"))
    assert df.first().topics == ["a", "b"]
    assert [tuple(r) for r in schema.violations(df, "id").collect()] == [(1, "content_type", "unknown value")]
    with pytest.raises(MissingScopeError):
        Scope(" ")
    rows = spark.createDataFrame([("u", 1), ("v", 2)], "user_id string, x int")
    assert [r.x for r in Scope("u").apply(rows).collect()] == [1]
    assert profiles(spark).count() == 7 and EngineConfig.from_conf(spark).rrf_k == 60


def test_split_text():
    body = "One two three. Four five six.\n\nSeven eight nine ten eleven twelve thirteen."
    parts = sqlapi.split_text(body, 30, 10)
    assert all(len(p) <= 30 for p in parts) and "One two three." in parts[0]


def test_engine_end_to_end(spark, tmp_path):
    pages = spark.createDataFrame([("leave.pdf", 1, "Annual Leave\nEmployees get 25 days of annual leave each year.\nSick Leave\nSick leave is ten days."), ("it.pdf", 1, "Support Tickets\nTickets are closed after five days without reply.")], "source string, page int, text string")
    mine, other = Engine(spark, f"file://{tmp_path}", "u1"), Engine(spark, f"file://{tmp_path}", "u2")
    assert mine.ingest(pages).count() == 2 and mine.ingest(pages).count() == 0
    other.ingest(pages.filter("source = 'it.pdf'"))
    answer = mine.ask(spark.createDataFrame([(1, "how many days of annual leave do employees get")], "query_id int, text string")).first()
    assert "25 days" in answer.answer and answer.citations[0].source == "leave.pdf"
    assert {r.source for r in other.documents().collect()} == {"it.pdf"}
    mine.delete(["leave.pdf"])
    assert {r.source for r in mine.documents().collect()} == {"it.pdf"}


def test_ingest_reports_every_source(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "u1")
    pages = spark.range(1200).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(1).alias("page"), F.concat(F.lit("Text of page "), "id").alias("text"))
    first = engine.ingest(pages)
    changed = pages.withColumn("text", F.when(F.col("source") == "s7", "Other text").otherwise(F.col("text")))
    assert [tuple(r) for r in engine.ingest(changed).collect()] == [("s7", "ingested")]
    assert sorted(tuple(r) for r in first.collect()) == sorted((f"s{k}", "ingested") for k in range(1200))


def test_fuzzy_candidates_match_brute_force(spark):
    asked = ["rands", "ations", "ustome", "custmer", "the brand", "acount 7", "x 7", "of 12", "abc", "segmen", "ustomer 000000042", "nationality", "ab"]
    labels = ["brand", "nation", "customer", "customer 000000042", "account 7", "account 12", "market segment", "b", "zebra", "abcdefg", "nationalities of all"]

    def words(x):
        return re.sub(r"\d+", " ", x).split()

    def meet(a, b):
        real = [w for w in words(a) if len(w) >= 3 and w not in facts.FILLER]
        return re.findall(r"\d+", a) == re.findall(r"\d+", b) and any(fuzzy.ratio(w, c) >= 60 for w in real for c in words(b))

    variants = spark.createDataFrame([(1, a, k, k + 1, a, 0) for k, a in enumerate(asked)], "query_id int, span string, start int, end int, variant string, variant_no int")
    choices = spark.createDataFrame([(b, b, ["t"]) for b in labels], "norm string, display string, table_ids array<string>")
    got = sorted((r.variant, r.norm) for r in facts.fuzzy_candidates(variants, choices).collect())
    assert got == sorted((a, b) for a in asked for b in labels if meet(a, b))
    assert {("rands", "brand"), ("ations", "nation"), ("ustome", "customer")} <= set(got)


def test_labels_are_cleaned(spark):
    from lodestrata.functions import text

    long = "x" * 150
    labels = [None, " Sick   leave. ", "sick LEAVE", ";,", "", long, long, "pay,", "Pay", "third"]
    row = spark.createDataFrame([(labels,)], "l array<string>").select(text.clean_labels(F.col("l"), 4).alias("a"), text.clean_labels(F.col("l"), 9).alias("b")).first()
    assert row.a == ["Sick leave", "x" * 120, "x" * 120, "pay"] and row.b == [*row.a, "third"]
