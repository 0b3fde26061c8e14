from pyspark.sql import functions as F

from lodestrata.operators import context

CHUNK = "unit int, source string, section string, page int, page_end int, chunk_index int, content_type string, text string, tokens int"
PLAN = "query_id int, context_tokens int, document_order boolean, merge boolean"


def body(word, n):
    return " ".join(f"{word}{k}" for k in range(n))


def case(spark):
    chunks = [
        (1, "a", "1. Leave", 1, 1, 0, "other", body("leave", 70), 70), (2, "a", "1. Leave", 1, 1, 1, "other", body("more", 40), 40),
        (3, "a", "2. Pay", 2, 2, 2, "other", body("pay", 80), 80), (4, "a", "3. Tiny", 2, 2, 3, "other", body("tiny", 10), 10),
        (5, "a", "ab", 3, 3, 4, "other", body("short", 90), 90), (6, "a", "", 3, 3, 5, "other", body("none", 90), 90),
        (7, "b", "Tools", 1, 1, 0, "other", body("tool", 65), 65), (8, "c", "Outside", 1, 1, 0, "other", body("out", 99), 99),
    ]
    df = spark.createDataFrame(chunks, CHUNK)
    units = df.filter("unit IN (2, 7)").select(F.explode(F.array(F.lit(1), F.lit(2))).alias("query_id"), "*", (F.lit(5.0) - F.col("unit") / 10).alias("relevance")).drop("tokens")
    routed = spark.createDataFrame([(q, s) for q in (1, 2) for s in ("a", "b")], "query_id int, source string")
    return df, units, routed


def test_major_sections_get_their_opening_chunk(spark):
    chunks, units, routed = case(spark)
    both, report = context.with_coverage(units, chunks, routed)
    got = {(r.unit, round(r.relevance, 3), r.coverage) for r in both.filter("query_id = 1").collect()}
    # Leave's opener isn't there though another of its chunks is; Tools' is; small, short and foreign sections aren't added
    assert got == {(2, 4.8, False), (7, 4.3, False), (1, 5.3, True), (3, 5.3, True)}
    assert {tuple(r) for r in report.collect()} == {(q, 5, 3, 1, 2) for q in (1, 2)}


def test_coverage_beyond_the_budget_is_assembled_again(spark):
    chunks, units, routed = case(spark)
    plans = spark.createDataFrame([(1, 1000, True, False), (2, 100, True, False)], PLAN)
    whole, used, report = context.covered_context(units, chunks, routed, plans)
    placed = {}
    for r in used.collect():
        placed.setdefault(r.query_id, set()).add(r.unit)
    assert placed[1] == {1, 2, 3, 7}  # all fit at once
    # 100 tokens hold one of the two added sections (and nothing besides); 160 hold both
    assert placed[2] == {1, 3}
    told = {r.query_id: r.still_missing for r in report.collect()}
    assert told == {1: [], 2: []} and whole.count() == 2
    tight = spark.createDataFrame([(1, 1000, True, False), (2, 60, True, False)], PLAN)
    _, used, report = context.covered_context(units, chunks, routed, tight)
    left = {r.query_id: r.still_missing for r in report.collect()}
    assert left[1] == [] and len(left[2]) == 1 and left[2][0].startswith("a: ")


def test_nothing_retrieved_and_nothing_routed(spark):
    chunks, units, routed = case(spark)
    both, report = context.with_coverage(units.limit(0), chunks, routed.filter("query_id = 1"))
    assert {(r.unit, r.relevance) for r in both.collect()} == {(1, 2.5), (3, 2.5), (7, 2.5)} and report.first().covered_before == 0
    both, report = context.with_coverage(units, chunks, routed.limit(0))
    assert both.filter("coverage").count() == 0 and report.count() == 0
