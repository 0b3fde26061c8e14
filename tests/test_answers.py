"""Operators between a question and its answer against plain Python or cases worked out by hand."""

import json
import random
import re

from pyspark.sql import functions as F

from lodestrata.functions import fuzzy, text
from lodestrata.operators import context, facts, ground, manifest, planner, routing, tables
from lodestrata.plans import answer_queries, catalog, facts_queries
from lodestrata.sources.store import Store
from lodestrata.streaming import jobs

SF = "/root/testdata/sf0.001"
TOKENS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")


def runs_of(value, n=8):
    words = " ".join(value.split()).lower().split(" ") if value.strip() else []
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def greedy(units):
    """Names of units (name, text) in order, without those an earlier kept one repeats or contains."""
    kept = []
    for name, value in units:
        flat, runs = " ".join(value.split()).lower(), runs_of(value)
        if not any(flat == f or (runs and len(runs & r) >= 0.8 * len(runs)) for _, f, r in kept):
            kept.append((name, flat, runs))
    return [k[0] for k in kept]


def test_greedy_dedup(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    pools = {}
    for r in sorted(rows, key=lambda r: r.turn):
        pools.setdefault(r.conv_id, []).append((r.turn, r.text))
    pools[-1] = [(1, "one two three four five six seven eight nine ten"), (2, "ONE two  three four five six seven eight"), (3, "ten nine"), (4, "Ten nine"), (5, "")]
    extra = spark.createDataFrame([(-1, k, "user", t) for k, t in pools[-1]], "conv_id long, turn long, role string, text string")
    df = spark.createDataFrame([(r.conv_id, int(r.turn), r.role, r.text) for r in rows], extra.schema).union(extra)
    got = sorted((r.conv_id, r.turn) for r in context.greedy_dedup(df, "conv_id", "turn", "turn").collect())
    assert got == sorted((c, k) for c, units in pools.items() for k in greedy(units))


def test_greedy_dedup_of_large_pools(spark):
    """Chains of units that contain each other, equal ones and a null pool, without a pool in one row."""
    rng, rows = random.Random(12), []
    for pool in (1, 2, None):
        words = [f"w{rng.randrange(60)}" for _ in range(160)]
        for k in range(150):
            low = rng.randrange(120)
            part = words[low : low + rng.choice([3, 8, 12, 20, 40])]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "other"
            rows.append((pool, k, rng.choice(["", "  "]).join([" ".join(part)]).upper() if rng.random() < 0.2 else " ".join(part)))
    out = context.greedy_dedup(spark.createDataFrame(rows, "q int, o int, text string").repartition(3), "q", "o", "o")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want = {(q, o) for pool in (1, 2, None) for q, o in [(pool, k) for k in greedy([(o, t) for q, o, t in rows if q == pool])]}
    assert {(r.q, r.o) for r in out.collect()} == want


def test_budget_of_many_rows(spark):
    """What may fit is bounded by the budget, and it is what a walk over all rows takes."""
    rng = random.Random(6)
    rows = [(q, k, rng.choice([0, 1, 2, 7, 30, 99, 100, 101, 500])) for q in range(4) for k in range(2000)]
    rows = [r for r in rows if r[0] != 3 or r[2] > 100] + [(4, 0, 500), (4, 1, 0), (5, 0, 100), (5, 1, 0)]
    units = spark.createDataFrame(rows, "q int, o int, tokens int")
    want, used = set(), {}
    for q, k, n in rows:
        if q not in used or used[q] + n <= 100:
            used[q] = used.get(q, 0) + n
            want.add((q, k))
    assert {(r.q, r.o) for r in context.fill(units, "q", "o", "tokens", 100).collect()} == want
    few = context.within_budget(units.filter("tokens > 0"), "q", [F.col("o")], "tokens", 100)
    assert few.groupBy("q").count().agg(F.max("count")).first()[0] <= 250


def test_labels_of_any_script(spark):
    values = ["Österreich", "Congé payé", "日本", "(Größe) – mm:", "--A1--", "ÉTÉ."]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r.x for r in df.select(text.normalise_label(F.col("t")).alias("x")).collect()] == ["österreich", "congé payé", "日本", "größe – mm", "a1", "été"]


def packed(sizes, cap, most=None):
    groups, used = [[]], 0
    for k, n in enumerate(sizes):
        if groups[-1] and (used + n > cap or (most and len(groups[-1]) >= most)):
            groups.append([])
            used = 0
        groups[-1].append(k)
        used += n
    return groups


def test_table_documents(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").collect()
    by_size = {}
    for p in parts:
        by_size.setdefault(p.p_size, []).append(p)
    want = {}
    for size, rows in by_size.items():
        objects = [{"Type": p.p_type, "Name": p.p_name, "Brand": p.p_brand, "col4": str(p.p_size)} for p in rows]
        bodies = [json.dumps(o, separators=(",", ":"), ensure_ascii=False) for o in objects]
        labels = [f"{p.p_type}:{p.p_name}" for p in rows]
        for n, group in enumerate(packed([len(TOKENS.findall(b)) for b in bodies], 350, 10), 1):
            want[size, n] = ([objects[k] for k in group], list(dict.fromkeys(labels[k] for k in group)))
    got = {}
    for r in answer_queries.table_documents(spark, SF).collect():
        summary, body = r.text.split("\n", 1)
        assert summary.startswith(f"Table: Parts of size {r.table_id}; columns: Type, Name, Brand; rows: ")
        got[r.table_id, r.table_part] = (json.loads(body), r.entities.split("|"))
    assert got == want
    read = answer_queries.table_documents(spark, SF).select("table_id", "table_part", tables.chunk_rows(F.col("text")).alias("rows"), tables.json_values(F.col("text")).alias("values")).collect()
    for r in read:
        objects = want[r.table_id, r.table_part][0]
        assert r.rows == objects and set(r["values"]) == {v.lower() for o in objects for v in o.values()}


def test_parts_of_a_table(spark):
    rows = [(1, "Limits", ["Code", "Max"], k, 1 + k // 3, [f"E-{k}", str(k)]) for k in range(5)] + [(1, "Limits", ["Code", "Max"], 9, 2, ["", None])]
    df = spark.createDataFrame(rows, "table_id int, section string, header array<string>, row_index int, page int, cells array<string>")
    got = {r.table_part: r.text for r in tables.legacy_documents(df, cap=15).collect()}
    assert got[0] == "Table: Limits; columns: Code, Max; rows: E-0, E-1, E-2, E-3, E-4; 6 rows; page 1-2"
    assert got[1] == "Limits (table, page 1, part 1 of 2)\nCode | Max\n--- | ---\nE-0 | 0\nE-1 | 1\nE-2 | 2"
    assert [r.x for r in spark.createDataFrame([(got[2],)], "t string").select(tables.bare_part(F.col("t")).alias("x")).collect()] == ["E-3 | 3\nE-4 | 4"]


def test_plan_of_a_workflow(spark):
    ranked = spark.createDataFrame([(1, "S1"), (1, "S2"), (1, "S10"), (2, "S1")], "query_id int, key string")
    stages = [(1, 2, "Check", "look", ["S2", "S77"]), (1, 1, " Begin ", None, ["S1"]), (1, 3, " ", "x", ["S2"]), (2, 1, "Alone", "", ["S1"])]
    kept, left = planner.validated(ranked, spark.createDataFrame(stages, "query_id int, stage_no int, title string, purpose string, keys array<string>"))
    plan = planner.rendered(kept, left).collect()
    assert len(plan) == 1 and plan[0].plan == "Stage 1: Begin\n    Use: S1\nStage 2: Check -- look\n    Use: S2\nSections not assigned to any stage (use only if genuinely relevant): S10"


def test_scope_escalation_and_guaranteed_rows(spark):
    plans = routing.plans(spark.createDataFrame([(1, "what is the leave policy"), (2, "are there conflicts across our policies")], "query_id int, text string"))
    routed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id int, source string")
    locks = spark.createDataFrame([(1, "b")], "query_id int, source string")
    assert [tuple(r) for r in routing.search_scope(routed, locks, plans).collect()] == [(1, "b")]
    answers = spark.createDataFrame([(1, "I don't know based on the available documents."), (2, "I don't know based on the available documents.")], "query_id int, text string")
    again = routing.escalations(plans, answers).collect()
    assert [(r.query_id, r.mode) for r in again] == [(1, "multi_hop")]
    first = routing.put_first(spark.createDataFrame([(1, 9), (1, 2)], "query_id int, k int"), spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id int, k int, position int"), "k")
    assert [(r.k, r.position) for r in first.orderBy("position").collect()] == [(2, 1), (9, 2), (3, 3)]
    parts = spark.createDataFrame([(1, "What is the leave policy"), (1, "sick leave")], "query_id int, text string")
    assert {r.text for r in routing.query_set(plans.filter("query_id = 1"), parts).collect()} == {"what is the leave policy", "sick leave"}


def test_enforced_answers(spark):
    answers = [(1, "The fee is 20."), (2, "The fee is 20. The cap is 99."), (3, "The fee is 20 and the cap is 99."), (4, "The cap is 99."), (5, "The fee is 20. The cap is 99.")]
    df = spark.createDataFrame(answers, "id int, text string")
    sources = spark.createDataFrame([(k, "A fee of 20 applies.") for k in range(1, 6)], "id int, text string")
    bad = ground.unsupported(df, sources, "id").groupBy("id").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    verdicts = ground.verdicts(df, sources, "id", judged=bad)
    repaired = spark.createDataFrame([(5, "Pay 20."), (2, "No fee.")], "id int, text string")
    got = {r.id: (r.action, r.text) for r in ground.enforce(df, sources, verdicts, "id", "NO", repaired).collect()}
    assert got == {
        1: ("kept", "The fee is 20."), 2: ("pruned", "The fee is 20."), 3: ("refused", "NO"),
        4: ("refused", "NO"), 5: ("repaired", "Pay 20."),
    }
    saved = ground.verdicts(df, sources, "id", judged=bad, cells=spark.createDataFrame([(4, "99")], "id int, value string")).filter("id = 4").first()
    assert saved.faithful and saved.unsupported == [] and saved.note.startswith("dropped")


def test_claims_worth_a_repair_and_second_looks(spark):
    hedge = "The fee is 20. The documents do not specify a cap."
    answers = [
        (1, hedge), (2, hedge + " It is 99."), (3, "The fee is 20 and the cap is 99. Ask the office."), (4, "The cap is 99. The fee is 20."),
        (5, "The cap is 99. The fee is 20."), (6, "The cap is 99. The fee is 20."), (7, "The cap is 99. The fee is 20."),
    ]
    df = spark.createDataFrame(answers, "id int, text string")
    sources = spark.createDataFrame([(k, "A fee of 20 applies.") for k in range(1, 8)], "id int, text string")
    flagged = [(1, ["documents do not specify a cap"]), (2, ["documents do not specify a cap", "99"]), *[(k, ["99"]) for k in range(3, 8)]]
    verdicts = ground.verdicts(df, sources, "id", judged=spark.createDataFrame(flagged, "id int, claims array<string>"))
    repaired = [
        (4, "**I don't know based on the available documents.**"), (5, "I don't know based on the available documents. The fee is 20."),
        (6, "The fee is 20 and the limit is 77."), (7, "The fee applies."),
    ]
    got = {r.id: (r.action, r.text, r.faithful) for r in ground.enforce(df, sources, verdicts, "id", "NO", spark.createDataFrame(repaired, "id int, text string")).collect()}
    assert got == {
        1: ("kept", hedge, True),  # what the documents lack is no claim
        2: ("pruned", "The fee is 20.\nThe documents do not specify a cap.", True),
        3: ("fenced", "The fee is 20 and the cap is 99. Ask the office.\n\n[Unverified -- not confirmed by the documents: 99]", False),
        4: ("refused", "NO", True),  # the rewrite withdraws
        5: ("repaired", "The fee is 20.", True),
        6: ("pruned", "The fee is 20.", True),  # the rewrite brings a new figure
        7: ("pruned", "The fee is 20.", True),  # the rewrite loses a supported one
    }
    again = spark.createDataFrame([(6, []), (5, ["the fee is 20"])], "id int, claims array<string>")
    second = {r.id: r.action for r in ground.enforce(df, sources, verdicts, "id", "NO", spark.createDataFrame(repaired, "id int, text string"), rejudged=again).collect()}
    assert second[6] == "repaired" and second[5] == "refused"  # the judge accepts 6, and finds that nothing of 5 stands


def plain_choice(rows, mode, final_k, least, guaranteed=()):
    """The rule in plain Python: rows are dicts in order of position."""
    window = rows if mode == "sweep" else rows[: max(4 * final_k, final_k + 10)]
    if len(window) <= final_k or all(r["rerank"] is None for r in window):
        return [r["k"] for r in window[:final_k]]
    left = [r for r in window if r["rerank"] is None or r["rerank"] >= least]
    if mode == "sweep":
        return [r["k"] for r in (sorted(left, key=lambda r: (r["source"], r["chunk_index"])) or window[:final_k])]
    best = sorted(left, key=lambda r: (-(r["rerank"] or 0), -r["fused"]))[:final_k] or window[:final_k]
    picked = [r["k"] for r in best]
    return [r["k"] for r in rows if r["k"] in guaranteed and r["k"] not in picked] + picked


def test_choice_against_plain_python(spark):
    rng = random.Random(5)
    rows, plans, want, sure = [], [], {}, []
    for q in range(60):
        mode, n, judge = rng.choice(["focused", "sweep", "outline", "per_entity"]), rng.choice([2, 4, 9, 30]), rng.choice(["none", "some", "low"])
        own = []
        for k in range(n):
            score = None if judge == "none" or rng.random() < 0.2 else rng.randint(0, 1 if judge == "low" else 3)
            own.append({"k": k, "rerank": score, "fused": round(rng.random(), 6), "source": f"s{rng.randint(0, 2)}", "chunk_index": k})
        first = [0, n - 1] if q % 3 == 0 else []
        rows += [(q, r["k"], p, r["rerank"], r["fused"], r["source"], r["chunk_index"]) for p, r in enumerate(own, 1)]
        plans.append((q, mode, 4, 2))
        sure += [(q, k) for k in first]
        want[q] = plain_choice(own, mode, 4, 2, first)
    df = spark.createDataFrame(rows, "query_id int, k int, position int, rerank int, fused double, source string, chunk_index int")
    plans = spark.createDataFrame(plans, "query_id int, mode string, final_k int, min_rerank int")
    got = {}
    for r in routing.chosen(df, plans, "k", spark.createDataFrame(sure, "query_id int, k int")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.k)
    assert got == want


def test_items_of_a_list(spark):
    items = [("Leave", "Sick leave"), ("Leave", "Sick leave - contractors"), ("Leave", "Annual leave"), ("Tools", "Hammer")]
    df = spark.createDataFrame(items, "group_label string, item string")
    assert sorted(r.item for r in manifest.without_elaborations(df, ["group_label"]).collect()) == ["Annual leave", "Hammer", "Sick leave"]
    asked = spark.createDataFrame([(1, "leave"), (2, "hammer"), (3, "sick leave")], "query_id int, term string")
    got = {r.query_id: (r.group_label, r.whole, r.n_items) for r in manifest.enumeration_plan(asked, df).collect()}
    # a group that is named counts whole; a single matching item is no plan
    assert got == {1: ("Leave", True, 3), 3: ("Leave", False, 2)}


def test_pruned_units(spark):
    answer = "Fees are 20. The cap is 99.\n| a | b |\n|---|---|\n| x | 99 |\n- keep this\n- drop 99"
    out = ground.prune(spark.createDataFrame([(1, answer), (2, "Nothing wrong.")], "id int, text string"), spark.createDataFrame([(1, "99")], "id int, claim string"), "id")
    assert {r.id: r.text for r in out.collect()} == {1: "Fees are 20.\n- keep this", 2: "Nothing wrong."}


def test_assembled_context(spark):
    """The blocks of each question, in plain Python."""
    units, plans = answer_queries._units(spark, SF)
    rules = {r.query_id: r for r in plans.collect()}
    rows = {}
    for r in units.collect():
        rows.setdefault(r.query_id, []).append(r)
    got = {r.query_id: r for r in context.assemble(units, plans)[0].collect()}
    for q, own in rows.items():
        own.sort(key=lambda r: (-r.relevance, r.unit))
        names = set(greedy([(r.unit, r.text) for r in own]))
        sections = {}
        for r in sorted((r for r in own if r.unit in names), key=lambda r: (r.source, r.section, r.chunk_index, r.unit)):
            runs = sections.setdefault((r.source, r.section), [])
            if rules[q].merge and runs and 1 <= r.chunk_index - runs[-1][-1].chunk_index <= 2:
                runs[-1].append(r)
            else:
                runs.append([r])
        pool = sorted(((-max(r.relevance for r in run), *key, n, run) for key, runs in sections.items() for n, run in enumerate(runs)), key=lambda x: x[:4])
        used, taken = 0, {}
        for _, source, section, _, run in pool:
            size = len(TOKENS.findall("\n".join(r.text for r in run)))
            if not taken or used + size <= rules[q].context_tokens:
                used += size
                taken.setdefault((source, section), []).append(run)
        assert got[q].n_blocks == len(taken), q
        parts = got[q].text.split("\n\n---\n\n")
        heads = {re.match(r"\[\d+\] (\S+), .*section: (part \d+)$", p.split("\n")[0]).groups() for p in parts}
        assert heads == set(taken)
        if rules[q].document_order:
            want = sorted(taken, key=lambda k: (k[0], min(r.chunk_index for run in taken[k] for r in run)))
            assert [re.match(r"\[\d+\] (\S+), .*section: (part \d+)$", p.split("\n")[0]).groups() for p in parts] == want


def test_stream_of_documents(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("\n".join(json.dumps({"source": s, "text": t}) for s, t in rows))
    store, calls = Store(spark, f"file://{tmp_path}/store"), []

    def run():
        stream = spark.readStream.schema("source string, text string").json(str(folder))
        jobs.ingest(stream, store, f"{tmp_path}/checkpoint", lambda fresh: fresh.select("source", F.length("text").alias("n")), after=lambda: calls.append(1)).awaitTermination()

    put("1.json", [("a", "one"), ("b", "three")])
    run()
    put("2.json", [("a", "one"), ("b", "seven letters")])
    run()
    assert sorted(tuple(r) for r in store.read("chunks").collect()) == [("a", 3), ("b", 13)]
    assert len(calls) == 2


def test_union_of_groups(spark):
    rows = [
        ("d1", "Chapter 1", "VPN Request"), ("d1", "Chapter 2", "Access Request"), ("d1", "Chapter 3", "Hardware Request"), ("d1", "Chapter 3", "VPN Request - Exceptions"),
        ("d1", "Chapter 4", "access request"), ("d1", "Chapter 1", "Types of Request"), ("d2", "Chapter 9", "Other Request"), ("d2", "Faults", "E-01"), ("d2", "Faults", "E-02"),
    ]
    items = spark.createDataFrame(rows, "document_id string, group_label string, item string")
    terms = spark.createDataFrame([(1, "request"), (2, "fault"), (3, "other request")], "query_id int, term string")
    got = {r.query_id: (r.term, r.document_id, [x.lower() for x in r.items], r.n_items, r.score) for r in manifest.union_plan(terms, items).collect()}
    assert got == {1: ("request", "d1", ["access request", "hardware request", "vpn request"], 3, 1.75)}
    best = {r.query_id: (r.kind, r.label, r.n_items) for r in manifest.best_plan(terms, items).collect()}
    # no single chapter holds two requests that score more; the faults stand in one group
    assert best == {1: ("union", "d1", 3), 2: ("group", "Faults", 2)}
    few = manifest.union_plan(terms, items, most=2).first()
    assert few.n_items == 2 and few.truncated_from == 3 and len(few["items"]) == 2


def test_every_engine_query_is_checked():
    """Queries without SQL are those that a test compares with plain Python."""
    tested = {"greedy_dedup", "enumeration_plan", "fuzzy_resolve", "fact_ask", "prune_units", "table_documents", "table_parts", "assemble_context", "enforced_answers", "ann_topk", "parent_child_chunks"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == tested


def named(question, norms):
    """The entry that a question names (span, norm, score), by trying every run of words against every entry."""
    tokens = [t for t in (re.sub(r"'s$|'$", "", x) for x in re.findall(text.LABEL_TOKEN, question.lower())) if t]
    spans = [(" ".join(tokens[a : a + n]), a, a + n) for n in range(1, 5) for a in range(len(tokens) - n + 1)]
    tries = []
    for span, a, b in spans:
        forms = [span]
        for word, others in text.SYNONYMS.items():
            if span == word:
                forms += others
            elif f" {word} " in f" {span} ":
                forms += [span.replace(word, o) for o in others]
        tries += [(span, a, b, k, v) for k, v in enumerate(dict.fromkeys(forms))]
    exact = sorted((-(b - a), a, k, span, v) for span, a, b, k, v in tries if v in norms)
    if exact:
        return exact[0][3], exact[0][4], 100.0
    words = lambda x: re.sub(r"\d+", " ", x).split()
    found = []
    for span, a, b, _, v in tries:
        real = [w for w in words(v) if len(w) >= 3 and w not in facts.FILLER]
        if not re.fullmatch(r"\s*\d+\s*", v):
            for norm in norms:
                if re.findall(r"\d+", v) == re.findall(r"\d+", norm) and any(fuzzy.ratio(w, c) >= 60 for w in real for c in words(norm)):
                    found.append((-round(fuzzy.weighted_ratio(v, norm), 4), -(b - a), a, norm, span))
    return (min(found)[4], min(found)[3], -min(found)[0]) if found else None


def test_names_in_questions(spark):
    norms = {"column": set(), "entity": set()}
    for r in facts.vocabulary(facts_queries._customers(spark, SF)).collect():
        norms[r.kind].add(r.norm)
    want = {(q, kind): named(asked, norms[kind]) for q, asked in facts_queries._ASKED for kind in norms}
    got = {(r.query_id, r.kind): (r.span, r.norm, round(r.score, 4)) for r in facts_queries.fuzzy_resolve(spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_facts_from_questions(spark):
    rows = facts_queries._customers(spark, SF).collect()
    value = {(r.entity_norm, r.column_name): r.value for r in rows}
    balance = {r.entity: float(r.value) for r in rows if r.column_name == "Account balance"}
    got = {r.query_id: r for r in facts_queries.fact_ask(spark, SF).collect()}
    assert (got[1].kind, got[1].verdict, got[1].entity) == ("max", "confident", max(balance, key=balance.get))
    assert (got[3].kind, got[3].verdict, got[3].n_rows) == ("count", "confident", sum(v > 5000 for v in balance.values()))
    assert got[2].verdict == "confident" and got[2].value == value["customer 000000042", "Market segment"]
    assert got[5].verdict == "confident" and got[5].value == value["customer 000000010", "Account balance"]
    assert got[4].verdict == got[6].verdict == "skipped"
