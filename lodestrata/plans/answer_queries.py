"""From plan to verdict: routing, modes, tables as documents, manifests, assembly, verification, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROFILES
from ..functions import text
from ..operators import context, ground, library, manifest, planner, rank, routing, tables
from .common import Registry, table
from .retrieval_queries import _FUSED, _GATED, _ROUTED, _TOK, _fused

_r = Registry()
add = _r.add
QUERIES, ORACLE = _r.queries, _r.oracle

_QUESTIONS = [
    (1, "what is the leave policy"), (2, "list all vendors in Tier 1"), (3, "compare the Security Handbook versus the Travel Policy"), (4, "how do I submit an expense report"),
    (5, "summarize the onboarding guide"), (6, "which approvals are needed given that the amount exceeds AB-12"), (7, "are there conflicts across our policies"), (8, "design a workflow for new starters end to end"),
]


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_INTENT = "coalesce(CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){_sql(p)}') THEN '{n}'" for n, p in text.INTENT_PATTERNS.items()) + " END, 'fact_lookup')"
_P = "profiles(intent, mode, candidate_k, final_k, max_per_source, min_rerank) AS (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}, {p[3]}, {p[4]}, {p[8]})" for p in PROFILES) + ")"


_FORMS = "[" + ", ".join(f"'{_sql(q)}'" for _, q in _QUESTIONS) + "]"
#: Every user turn asks, in one of the forms above.
_TURNS = f"""turns AS (SELECT conv_id * 1000 + turn AS query_id, list_extract(({_FORMS}), ((conv_id + turn) % {len(_QUESTIONS)} + 1)::INTEGER) || ' ' || replace(text, chr(10), ' ') AS text FROM conversations WHERE role = 'user')"""


def _turns(spark, sf_dir) -> DataFrame:
    form = F.get(F.array(*[F.lit(q) for _, q in _QUESTIONS]), ((F.col("conv_id") + F.col("turn")) % len(_QUESTIONS)).cast("int"))
    said = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(form, F.lit(" "), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("text"))


@add(f"WITH {_TURNS}, {_P}, i AS (SELECT query_id, text, {_INTENT} AS intent FROM turns) SELECT query_id, intent, mode, candidate_k::INTEGER AS candidate_k, final_k::INTEGER AS final_k, max_per_source::INTEGER AS max_per_source, min_rerank::INTEGER AS min_rerank FROM i JOIN profiles USING (intent)")
def plan_profiles(spark, sf_dir):
    return routing.plans(_turns(spark, sf_dir)).select("query_id", "intent", "mode", "candidate_k", "final_k", "max_per_source", "min_rerank")


@add(f"""WITH {_TURNS}, i AS (SELECT query_id, text, {_INTENT} AS intent FROM turns)
    SELECT query_id, CASE WHEN regexp_matches(text, '{_sql(routing.COMBINING)}') THEN 'combination/workflow' WHEN intent = 'synthesis' OR regexp_matches(text, '{_sql(routing.DOCUMENT_WIDE)}') THEN 'document-wide' WHEN intent = 'fact_lookup' THEN 'point-lookup' ELSE 'other' END AS path FROM i""")
def orchestration_intent(spark, sf_dir):
    q = routing.plans(_turns(spark, sf_dir))
    return q.select("query_id", routing.orchestration(F.col("text"), F.col("intent")).alias("path"))


# ---------------------------------------------------------------- routing signals

_STOP = "[" + ", ".join(f"'{w}'" for w in routing.ROUTING_STOP) + "]"
_TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9''-]+'), lambda w: lower(w)), lambda w: NOT list_contains(" + _STOP + ", w) AND length(w) > 2))"
_ENTITIES = "list_distinct(list_filter(list_transform(regexp_extract_all({t}, '" + _sql(routing.ENTITY).replace("{", "{{").replace("}", "}}") + "'), lambda w: lower(trim(w))), lambda w: NOT list_contains(" + _STOP + ", w)))"
_REFERRING = f"regexp_matches(q, '{_sql(routing.REFERENCE)}')"

#: Every routed document has a title of two words; the questions name one, two or none, or refer back.
_DOCS = rf"""{_ROUTED},
    asks AS (SELECT DISTINCT query_id, CASE (query_id // 100) % 5 WHEN 0 THEN 'what does notes src1 say about Lyon' WHEN 1 THEN 'compare notes src2 with notes src3' WHEN 2 THEN 'notes src4 or notes src5, says Berlin' WHEN 3 THEN 'what else is in this document' ELSE 'notes src6 src7 as Lyon has it' END AS q, 'src' || (query_id // 100) % 4 || '.pdf' AS focus FROM routed),
    docs AS (SELECT r.query_id, r.source || '.pdf' AS source, 'Notes ' || r.source AS doc_title, ['Lyon ' || r.source] AS top_sections, r.score FROM routed r),
    words AS (SELECT d.*, q, focus, {_TERMS.format(t='q')} AS qt, list_distinct(list_concat({_TERMS.format(t='doc_title')}, {_TERMS.format(t="replace(replace(regexp_replace(source, '(?i)[.]pdf$', ''), '_', ' '), '-', ' ')")})) AS tt,
        {_ENTITIES.format(t='q')} AS qe, {_ENTITIES.format(t="doc_title || ' ' || replace(source, '_', ' ') || ' ' || array_to_string(top_sections, ' ')")} AS de FROM docs d JOIN asks USING (query_id)),
    named AS (SELECT *, len(tt) > 0 AND len(list_filter(tt, lambda x: NOT list_contains(qt, x))) = 0 AS named FROM words),
    signals AS (SELECT *, CASE WHEN len(qt) = 0 OR len(tt) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qt, tt))::DOUBLE / len(list_distinct(list_concat(qt, tt))) END AS title,
        (named OR (focus = source AND {_REFERRING}))::INTEGER::DOUBLE AS reference, (focus = source)::INTEGER::DOUBLE AS focused, CASE WHEN len(qe) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qe, de))::DOUBLE / len(qe) END AS entity FROM named)"""


def _routed_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    routed = rank.score_documents(_fused(spark, sf_dir), "vec_id")
    k = F.floor(F.col("query_id") / 100)
    asked = F.when(k % 5 == 0, "what does notes src1 say about Lyon").when(k % 5 == 1, "compare notes src2 with notes src3").when(k % 5 == 2, "notes src4 or notes src5, says Berlin").when(k % 5 == 3, "what else is in this document").otherwise("notes src6 src7 as Lyon has it")
    questions = routed.select("query_id").distinct().select("query_id", asked.alias("text"), F.concat(F.lit("src"), (k % 4).cast("string"), F.lit(".pdf")).alias("focus"))
    documents = routed.select("query_id", F.concat("source", F.lit(".pdf")).alias("source"), F.concat(F.lit("Notes "), "source").alias("doc_title"), F.array(F.concat(F.lit("Lyon "), "source")).alias("top_sections"), "score")
    return questions, documents


@add(f"WITH {_DOCS} SELECT query_id, source, round(title, 6) AS title, reference, focused AS focus, round(entity, 6) AS entity FROM signals")
def router_signals(spark, sf_dir):
    out = routing.signals(*_routed_documents(spark, sf_dir))
    return out.select("query_id", "source", F.round("title", 6).alias("title"), "reference", "focus", F.round("entity", 6).alias("entity"))


@add(f"""WITH {_DOCS}, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, score * (1 + 0.35 * (2 * ((title + reference + focused + entity) / 4) - 1)) AS moved FROM signals)
    SELECT query_id, source, round(CASE WHEN score >= 0.85 * best THEN greatest(score, moved) ELSE moved END, 6) AS refined FROM b""")
def router_refine(spark, sf_dir):
    return routing.refined(*_routed_documents(spark, sf_dir)).select("query_id", "source", F.round("refined", 6).alias("refined"))


@add(f"""WITH {_DOCS}, g AS (SELECT query_id, count(*) FILTER (WHERE named) AS n, min(source) FILTER (WHERE named) AS one, min(source) FILTER (WHERE {_REFERRING} AND focus = source) AS back FROM named WHERE NOT regexp_matches(q, '{_sql(routing.COMPARING)}') GROUP BY query_id)
    SELECT query_id, CASE WHEN n = 1 THEN one WHEN n = 0 THEN back END AS source FROM g WHERE CASE WHEN n = 1 THEN one WHEN n = 0 THEN back END IS NOT NULL""")
def document_lock(spark, sf_dir):
    return routing.document_lock(*_routed_documents(spark, sf_dir))


# ---------------------------------------------------------------- modes

_MODES = """plans AS (SELECT DISTINCT query_id, ['focused', 'sweep', 'outline', 'per_entity'][((query_id // 100) % 4 + 1)::INTEGER] AS mode FROM hits),
    pool AS (SELECT h.*, mode, mode = 'per_entity' AND coalesce(keyword_rank <= 2, false) AS f FROM hits h JOIN plans USING (query_id)),
    nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY f DESC, CASE WHEN f THEN keyword_rank END NULLS FIRST, fused DESC, vec_id) AS a, row_number() OVER (PARTITION BY query_id, source, lang ORDER BY fused DESC, vec_id) AS b FROM pool),
    kept AS (SELECT * FROM nth WHERE mode = 'sweep' OR (mode = 'outline' AND b <= 2) OR (mode NOT IN ('sweep', 'outline') AND a <= 3)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN mode = 'sweep' THEN source END NULLS FIRST, CASE WHEN mode = 'sweep' THEN vec_id END NULLS FIRST, f DESC, CASE WHEN f THEN keyword_rank END NULLS FIRST, fused DESC, vec_id) AS position FROM kept)"""


def _plans(hits: DataFrame) -> DataFrame:
    mode = F.element_at(F.array(*[F.lit(m) for m in ("focused", "sweep", "outline", "per_entity")]), (F.floor(F.col("query_id") / 100) % 4 + 1).cast("int"))
    return hits.select("query_id").distinct().select("query_id", mode.alias("mode"), F.lit(4).alias("final_k"), F.lit(3).alias("max_per_source"), F.lit(2).alias("min_rerank"), F.lit(2).alias("n_entities"))


def _placed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits = _fused(spark, sf_dir)
    plans = _plans(hits)
    pool = hits.select("query_id", "vec_id", "source", F.col("lang").alias("section"), F.col("vec_id").alias("chunk_index"), "fused", F.col("keyword_rank").alias("entity_rank"))
    return hits, plans, routing.candidates(pool, plans, "vec_id")


@add(f"WITH {_FUSED}, {_MODES} SELECT query_id, vec_id, position::INTEGER AS position FROM placed")
def mode_dispatch(spark, sf_dir):
    return _placed(spark, sf_dir)[2]


@add(f"""WITH {_FUSED}, {_MODES}, w AS (SELECT *, CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 4)::INTEGER END AS rerank FROM placed WHERE mode = 'sweep' OR position <= 16),
    j AS (SELECT *, rerank IS NULL OR rerank >= 2 AS passes, max((rerank IS NOT NULL)::INTEGER) OVER (PARTITION BY query_id) = 1 AND count(*) OVER (PARTITION BY query_id) > 4 AS judged FROM w),
    v AS (SELECT *, judged AND max(passes::INTEGER) OVER (PARTITION BY query_id) = 1 AS got FROM j),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN mode = 'sweep' AND got THEN source END NULLS FIRST, CASE WHEN mode = 'sweep' AND got THEN vec_id END NULLS FIRST, CASE WHEN got THEN coalesce(rerank, 0) END DESC NULLS LAST, CASE WHEN got THEN fused END DESC NULLS LAST, position) AS rank FROM v WHERE passes OR NOT got)
    SELECT query_id, vec_id, rank::INTEGER AS rank FROM s WHERE (mode = 'sweep' AND got) OR rank <= 4""")
def mode_selection(spark, sf_dir):
    hits, plans, placed = _placed(spark, sf_dir)
    rows = placed.join(hits.select("query_id", "vec_id", "fused", "source", F.col("vec_id").alias("chunk_index")), ["query_id", "vec_id"])
    return routing.chosen(rows.withColumn("rerank", F.when(F.col("vec_id") % 5 != 0, (F.col("vec_id") % 4).cast("int"))), plans, "vec_id")


@add(f"""WITH {_FUSED}, {_MODES} SELECT query_id, vec_id, position::INTEGER AS rank FROM placed WHERE position <= 4""")
def selection_without_judge(spark, sf_dir):
    """No reranker: the first rows as they are placed, so that those guaranteed by the plan keep their place."""
    hits, plans, placed = _placed(spark, sf_dir)
    rows = placed.join(hits.select("query_id", "vec_id", "fused", "source", F.col("vec_id").alias("chunk_index")), ["query_id", "vec_id"])
    return routing.chosen(rows.withColumn("rerank", F.lit(None).cast("int")), plans, "vec_id")


@add(f"""WITH {_FUSED}, u AS (SELECT query_id, source, lang AS section, vec_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS rank FROM hits),
    g AS (SELECT query_id, source, section, max(fused) AS score, min(vec_id) AS page, count(*) AS n_units, min(rank) AS first FROM u GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, source, section) AS k FROM g)
    SELECT query_id, source, section, score, page, n_units, 'S' || k AS key FROM o WHERE k <= 24""")
def section_planner(spark, sf_dir):
    hits = rank.top(_fused(spark, sf_dir), ["query_id"], [F.desc("fused"), "vec_id"], 1 << 20)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    units = hits.join(docs, "vec_id").select("query_id", "source", F.col("lang").alias("section"), F.col("vec_id").alias("page"), "text", F.lit(None).cast("int").alias("rerank"), "fused", "rank")
    return planner.ranked(planner.sections(units)).select("query_id", "source", "section", "score", "page", "n_units", "key")


# ---------------------------------------------------------------- tables as documents

_TABLES = """r AS (SELECT p_size AS table_id, 'Parts of size ' || p_size AS section, ['Type', 'Name', 'Brand', ''] AS header, p_partkey AS row_index, p_partkey // 50 AS page, [p_type, p_name, p_brand, p_size::VARCHAR] AS cells FROM part)"""


def _tables(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    header = F.array(F.lit("Type"), F.lit("Name"), F.lit("Brand"), F.lit(""))
    return p.select(F.col("p_size").alias("table_id"), F.concat(F.lit("Parts of size "), F.col("p_size").cast("string")).alias("section"), header.alias("header"), F.col("p_partkey").alias("row_index"), F.floor(F.col("p_partkey") / 50).alias("page"), F.array("p_type", "p_name", "p_brand", F.col("p_size").cast("string")).alias("cells"))


@add(f"""WITH {_TABLES}, f AS (SELECT table_id, cells[1] AS label, min(row_index) AS o FROM r WHERE cells[1] <> '' GROUP BY ALL), l AS (SELECT table_id, list(label ORDER BY o) AS labels FROM f GROUP BY 1),
    s AS (SELECT table_id, any_value(section) AS section, count(*) AS n, min(page) AS a, max(page) AS b FROM r GROUP BY 1)
    SELECT table_id, 'Table: ' || section || '; columns: Type, Name, Brand; rows: ' || array_to_string(labels[1:12], ', ') || CASE WHEN len(labels) > 12 THEN ', ...' ELSE '' END || '; ' || n || ' rows; page ' || CASE WHEN b > a THEN a || '-' || b ELSE a::VARCHAR END AS summary FROM s JOIN l USING (table_id)""")
def table_summaries(spark, sf_dir):
    return tables.summaries(_tables(spark, sf_dir))


@add()
def table_documents(spark, sf_dir):
    """Groups of rows as JSON under their table's summary; tests compare with plain Python."""
    return tables.table_documents(_tables(spark, sf_dir))


@add()
def table_parts(spark, sf_dir):
    """Parts with the header repeated, and a summary as part 0; tests compare with plain Python."""
    return tables.legacy_documents(_tables(spark, sf_dir))


@add("""WITH c AS (SELECT p_size AS table_id, unnest(['retail price', 'size']) AS column_norm, unnest([p_retailprice::DECIMAL(15, 2)::VARCHAR, p_size::VARCHAR]) AS value FROM part)
    SELECT table_id, column_norm, count(*) AS n, round(sum(value::DOUBLE), 4) AS total FROM c GROUP BY ALL""")
def column_totals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pairs = F.array(F.struct(F.lit("retail price").alias("c"), F.col("p_retailprice").cast("decimal(15,2)").cast("string").alias("v")), F.struct(F.lit("size").alias("c"), F.col("p_size").cast("string").alias("v")))
    return tables.column_totals(p.select(F.col("p_size").alias("table_id"), F.explode(pairs).alias("x")).select("table_id", F.col("x.c").alias("column_norm"), F.col("x.v").alias("value")))


# ---------------------------------------------------------------- manifests

_MANIFEST = """h AS (SELECT page_id // 10 AS document_id, regexp_extract(url, '^https?://([^/?#]+)', 1) || ' > ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) AS heading_path, page_id AS page, page_id AS chunk_index FROM pages),
    t AS (SELECT p_size AS document_id, 'src' || p_size AS source, p_size::VARCHAR AS table_id, CASE WHEN p_size % 2 = 0 THEN 'Parts' ELSE '' END AS section, p_partkey AS row_index, p_partkey // 50 AS page, p_name AS item FROM part),
    l AS (SELECT page_id // 10 AS document_id, 'Links' AS heading_path, page_id AS page, page_id AS chunk_index, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS item FROM pages),
    e AS (SELECT document_id, 'section' AS kind, string_split(heading_path, ' > ')[1] AS group_label, '' AS group_context, trim(string_split(heading_path, '>')[-1]) AS item, page, '' AS table_id, chunk_index AS o FROM h
        UNION ALL SELECT document_id, 'table_row', CASE WHEN section <> '' THEN section ELSE source END, 'Name', item, page, table_id, row_index FROM t WHERE item <> ''
        UNION ALL SELECT document_id, 'list_item', heading_path, '', item, page, '', chunk_index FROM l),
    d AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind, group_label, lower(trim(regexp_replace(regexp_replace(item, '^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+', ''), '\\s+', ' ', 'g'))) ORDER BY o, page, item) AS n FROM e)"""


def _manifest(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("document_id", F.floor(F.col("page_id") / 10))
    host, title = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    headings = pages.select("document_id", F.concat(host, F.lit(" > "), title).alias("heading_path"), F.col("page_id").alias("page"), F.col("page_id").alias("chunk_index"))
    items = pages.select("document_id", F.lit("Links").alias("heading_path"), F.col("page_id").alias("page"), F.col("page_id").alias("chunk_index"), F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))).alias("item"))
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    rows = p.select(size.alias("document_id"), F.concat(F.lit("src"), size.cast("string")).alias("source"), size.cast("string").alias("table_id"), F.when(size % 2 == 0, "Parts").otherwise("").alias("section"), F.array(F.lit("Name")).alias("header"), F.col("p_partkey").alias("row_index"), F.floor(F.col("p_partkey") / 50).alias("page"), F.array("p_name").alias("cells"))
    return manifest.build(headings, rows, items)


@add(f"WITH {_MANIFEST} SELECT document_id, kind, group_label, group_context, item, page, table_id FROM d WHERE n = 1")
def manifest_build(spark, sf_dir):
    return _manifest(spark, sf_dir).select("document_id", "kind", "group_label", "group_context", "item", "page", "table_id")


@add(f"""WITH {_MANIFEST}, i AS (SELECT document_id, kind, group_label, item, page, group_context FROM d WHERE n = 1), q(query_id, term) AS (VALUES (1, 'Ring'), (2, 'the'), (3, 'parts')),
    m AS (SELECT DISTINCT query_id, i.* FROM i JOIN q ON contains(lower(concat_ws(chr(10), item, group_label, group_context)), lower(term))),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, group_label, page NULLS LAST, item) AS k FROM m)
    SELECT query_id::INTEGER AS query_id, document_id, kind, group_label, item FROM k WHERE k <= 300""")
def manifest_search(spark, sf_dir):
    asked = spark.createDataFrame([(1, "Ring"), (2, "the"), (3, "parts")], "query_id int, term string")
    items = _manifest(spark, sf_dir).select("document_id", "kind", "group_label", "item", "page", "group_context")
    return manifest.find_items(items, asked).select("query_id", "document_id", "kind", "group_label", "item")


@add("""WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, turn AS chunk_index, CASE WHEN turn % 3 = 0 THEN 't' || turn ELSE '' END AS table_id, role AS heading_path, turn = 0 AS s FROM conversations),
    p AS (SELECT (document_id % 7)::INTEGER AS query_id, document_id, CASE WHEN chunk_index % 4 = 3 THEN table_id ELSE '' END AS table_id, CASE WHEN chunk_index % 4 < 2 THEN chunk_index END AS chunk_index, heading_path FROM c)
    SELECT DISTINCT query_id, c.chunk_id FROM p JOIN c ON c.document_id = p.document_id AND NOT c.s AND CASE WHEN p.table_id <> '' THEN c.table_id = p.table_id WHEN p.chunk_index IS NOT NULL THEN c.chunk_index = p.chunk_index ELSE p.heading_path <> '' AND c.heading_path = p.heading_path END""")
def manifest_targets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).otherwise("").alias("table_id"), F.col("role").alias("heading_path"), (F.col("turn") == 0).alias("is_table_summary"))
    k = F.col("chunk_index") % 4
    items = c.select((F.col("document_id") % 7).cast("int").alias("query_id"), "document_id", F.when(k == 3, F.col("table_id")).otherwise("").alias("table_id"), F.when(k < 2, F.col("chunk_index")).alias("chunk_index"), "heading_path")
    return manifest.targets(items, c)


# ---------------------------------------------------------------- assembly, verdicts, sources


def _units(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    units = c.select((F.col("conv_id") % 9).cast("int").alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"), F.concat(F.lit("part "), F.floor(F.col("turn") / 4).cast("string")).alias("section"), F.col("turn").alias("page"), F.col("turn").alias("page_end"), F.col("turn").alias("chunk_index"), F.lit("other").alias("content_type"), "text", (1.0 / (1 + F.col("turn"))).alias("relevance"))
    plans = units.select("query_id").distinct().select("query_id", F.lit(400).alias("context_tokens"), (F.col("query_id") % 2 == 0).alias("document_order"), (F.col("query_id") % 3 == 0).alias("merge"))
    return units, plans


@add()
def assemble_context(spark, sf_dir):
    """Contexts of nine questions from whole conversations; tests compare with plain Python."""
    return context.assemble(*_units(spark, sf_dir))[0]


_STRIP = r"regexp_replace({t}, '(?m)^\s*(?:[-*+]\s+|#{{1,6}}\s+)?\d+[.)]\s+', '', 'g')"
_CLAIMED = r"list_concat(list_filter(list_transform(regexp_extract_all({s}, '\b\d[\d,.]*\b'), lambda x: regexp_replace(replace(x, ',', ''), '\.+$', '')), lambda x: x <> ''), list_transform(regexp_extract_all({s}, '\b[A-Z]{{1,4}}-\d{{1,4}}\b|\bAES-?\d{{3}}\b|\bTLS\s?\d\.\d\b'), lambda x: upper(replace(x, ' ', ''))))"
_CLAIM = _CLAIMED.format(s=_STRIP.format(t="text"))


@add(f"""WITH a AS (SELECT doc_id, unnest({_CLAIM}) AS claim FROM documents), b AS (SELECT doc_id - 1 AS doc_id, claim FROM a),
    m AS (SELECT doc_id, list(DISTINCT claim ORDER BY claim) AS u FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.claim = a.claim) GROUP BY 1)
    SELECT d.doc_id, coalesce(len(m.u), 0) = 0 AS faithful, coalesce(array_to_string(m.u, ';'), '') AS unverified FROM documents d LEFT JOIN m USING (doc_id)""")
def grounding_verdicts(spark, sf_dir):
    """Whether the figures of each text stand in the one after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ground.verdicts(docs, docs.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "doc_id").select("doc_id", "faithful", F.array_join("unverified", ";").alias("unverified"))


@add(f"""WITH a AS (SELECT DISTINCT doc_id, claim FROM (SELECT doc_id, unnest({_CLAIM}) AS claim FROM documents)),
    r AS (SELECT DISTINCT doc_id, claim FROM (SELECT doc_id, unnest({_CLAIM}) AS claim FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents))),
    l AS (SELECT DISTINCT doc_id FROM a ANTI JOIN r ON a.doc_id = r.doc_id AND a.claim = r.claim)
    SELECT d.doc_id, l.doc_id IS NULL AS safe FROM documents d LEFT JOIN l USING (doc_id)""")
def repair_safety(spark, sf_dir):
    """Whether the first line of each text keeps all of its figures, the text itself being the context."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    short = docs.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("text"))
    return ground.repair_is_safe(docs, short, docs, "doc_id")


@add()
def enforced_answers(spark, sf_dir):
    """What may be said of each text if its figures must stand in the next one; tests compare with plain Python."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    bad = ground.unsupported(docs, following, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    return ground.enforce(docs, following, ground.verdicts(docs, following, "doc_id", judged=bad), "doc_id", "I don't know based on the available documents.")


@add("""WITH c AS (SELECT doc_id % 40 AS item_id, source, (doc_id % 3)::BIGINT AS page, lang AS section, min(doc_id) AS o FROM documents GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o) AS citation_no FROM c),
    f AS (SELECT c_custkey % 40 AS item_id, 'src' || c_custkey % 20 AS source, (c_custkey % 3)::BIGINT AS page, CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'Customers' END AS section, min(c_name || ' - Nation: ' || c_nationkey) AS snippet FROM customer GROUP BY ALL),
    x AS (SELECT f.* FROM f ANTI JOIN n ON f.item_id = n.item_id AND f.source = n.source AND f.page = n.page AND f.section = n.section), l AS (SELECT item_id, max(citation_no) AS l FROM n GROUP BY 1)
    SELECT item_id, citation_no::INTEGER AS citation_no, source, page, section, NULL::VARCHAR AS snippet FROM n
    UNION ALL SELECT x.item_id, (row_number() OVER (PARTITION BY x.item_id ORDER BY source, page, section) + coalesce(l, 0))::INTEGER, source, page, section, snippet FROM x LEFT JOIN l USING (item_id)""")
def fact_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "source", (F.col("doc_id") % 3).cast("long").alias("page"), F.col("lang").alias("section"), "doc_id", "text")
    cited = ground.citations(docs, "item_id", "doc_id").withColumn("snippet", F.lit(None).cast("string"))
    k = F.col("c_custkey")
    facts = table(spark, sf_dir, "customer").select((k % 40).alias("item_id"), F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"), (k % 3).cast("long").alias("page"), F.when(k % 2 == 0, "en").otherwise("Customers").alias("table_title"), F.col("c_name").alias("entity"), F.lit("Nation").alias("column"), F.col("c_nationkey").cast("string").alias("value"))
    return ground.with_fact_sources(cited, facts, "item_id").withColumn("citation_no", F.col("citation_no").cast("int"))


@add("""WITH u AS (SELECT conv_id, turn, generate_subscripts(i, 1) AS k, unnest(i) AS item FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]{5,}') AS i FROM conversations)),
    z AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) BETWEEN 2 AND 10), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(item) ORDER BY turn, k) AS n FROM u SEMI JOIN z USING (conv_id))
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k))::INTEGER AS position, item FROM f WHERE n = 1""")
def candidate_merge(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("unit_no"), F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)).alias("items"))
    return ground.merged_candidates(found, "conv_id")


# ---------------------------------------------------------------- owners, runs, scores

_SCORED = """r AS (SELECT doc_id, ['edge', 'refusal', 'table', 'plain'][(doc_id % 4 + 1)::INTEGER] AS category, (n_chars % 100) / 100.0::DOUBLE AS similarity, doc_id % 3 = 0 AS refused, doc_id % 2 = 0 AS exact, doc_id % 5 = 0 AS table_ok, doc_id % 7 = 0 AS stable FROM documents)"""


@add(f"""WITH {_SCORED} SELECT doc_id, category, CASE category WHEN 'edge' THEN 'behaviour' WHEN 'refusal' THEN 'refusal' WHEN 'table' THEN 'similarity+table' ELSE 'similarity+exact' END AS mode,
    CASE category WHEN 'edge' THEN stable OR refused WHEN 'refusal' THEN refused WHEN 'table' THEN similarity >= 0.75 AND table_ok ELSE similarity >= 0.75 AND exact END AS passed FROM r""")
def eval_scoring(spark, sf_dir):
    d = F.col("doc_id")
    category = F.element_at(F.array(*[F.lit(c) for c in ("edge", "refusal", "table", "plain")]), (d % 4 + 1).cast("int"))
    results = table(spark, sf_dir, "documents").select("doc_id", category.alias("category"), ((F.col("n_chars") % 100) / 100.0).alias("similarity"), (d % 3 == 0).alias("refused"), (d % 2 == 0).alias("exact"), F.lit(None).cast("boolean").alias("complete"), (d % 5 == 0).alias("table_ok"), (d % 7 == 0).alias("stable"))
    modes = spark.createDataFrame([("edge", "behaviour"), ("refusal", "refusal"), ("table", "similarity+table")], "category string, mode string")
    return library.scored(results, modes).select("doc_id", "category", "mode", "passed")


@add("SELECT o_custkey AS user_id, o_orderkey AS filename, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INTEGER AS position FROM orders")
def documents_newest_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("filename"), F.col("o_orderdate").alias("created_at"))
    return library.newest_first(o).select("user_id", "filename", "position")


@add("""WITH a AS (SELECT c_nationkey AS user_id, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT DISTINCT s_nationkey AS user_id FROM supplier)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, n IS NOT NULL AS has_cells, b.user_id IS NOT NULL AS has_documents, coalesce(n, 0) AS n_cells FROM a FULL JOIN b ON a.user_id = b.user_id""")
def owners(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("user_id"))
    return library.owners(cells, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("user_id")))


@add("""WITH r AS (SELECT o_custkey AS user_id, strftime(o_orderdate::TIMESTAMP, '%Y%m%dT%H%M%SZ') || o_orderkey AS run_id FROM orders) SELECT user_id, max(run_id) AS run_id FROM r GROUP BY 1""")
def latest_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(library.run_id(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey").cast("string")).alias("run_id"))
    return library.latest_runs(o)


@add("SELECT lang AS extraction_mode, count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chunks, sum(doc_id % 3)::BIGINT AS n_tables, sum(doc_id % 7)::BIGINT AS n_cells, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_skipped FROM documents GROUP BY 1")
def ingest_summary(spark, sf_dir):
    d = F.col("doc_id")
    return library.ingest_summary(table(spark, sf_dir, "documents").select(F.col("lang").alias("extraction_mode"), F.col("n_chars").alias("n_chunks"), (d % 3).alias("n_tables"), (d % 7).alias("n_cells"), (d % 5 == 0).alias("skipped")))


@add(f"""WITH {_GATED}, secs AS (SELECT source, source || ' in ' || lang AS section, min(doc_id) AS opener, sum({_TOK}) AS tokens FROM documents GROUP BY ALL),
    wanted AS (SELECT g.query_id, s.*, length(section) >= 4 AND tokens >= 60 AS major, h.vec_id IS NOT NULL AS there FROM gated g JOIN secs s USING (source) LEFT JOIN hits h ON h.query_id = g.query_id AND h.vec_id = s.opener)
    SELECT query_id, count(*) AS outline_sections, count(*) FILTER (WHERE major) AS major_sections, count(*) FILTER (WHERE major AND there) AS covered_before, count(*) FILTER (WHERE major AND NOT there) AS added FROM wanted GROUP BY query_id""")
def outline_coverage(spark, sf_dir):
    """Which sections of the routed documents lack their opening chunk among the hits; a source's texts in one language are a section."""
    hits = _fused(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    routed = rank.gate(rank.score_documents(hits, "vec_id")).select("query_id", "source")
    section = F.concat("source", F.lit(" in "), "lang")
    page = F.lit(1).alias("page")
    chunks = docs.select(F.col("doc_id").alias("unit"), "source", section.alias("section"), page, F.lit(1).alias("page_end"), F.col("doc_id").alias("chunk_index"), F.lit("other").alias("content_type"), "text", text.word_count_tokens(F.col("text")).alias("tokens"))
    units = hits.select("query_id", F.col("vec_id").alias("unit"), F.col("fused").alias("relevance")).join(chunks.drop("tokens"), "unit")
    return context.with_coverage(units, chunks, routed)[1]
