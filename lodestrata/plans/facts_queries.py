"""Exact facts over cells of the customer, part, supplier and nation tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import facts, ground
from ..sources.shared import settled
from .common import Registry, table

_r = Registry()
add = _r.add
QUERIES, ORACLE = _r.queries, _r.oracle


def _customers(spark, sf_dir):
    """Cells of customers, with names that a question's words can match."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = c.select("c_custkey", F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")).alias("name"), F.col("c_acctbal").cast("decimal(15,2)").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    return facts.cells(shown, "customer", "name", {"balance": "Account balance", "segment": "Market segment", "nation": "Nation"}, "c_custkey", "Customers", cap=None)


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("decimal(15,2)"))
    return facts.cells(p, "part", "p_name", {"price": "Retail price", "p_brand": "Brand", "p_size": "Size"}, "p_partkey", "Parts", cap=None)


_CELLS = """cells AS (
    SELECT c_custkey AS row_index, replace(c_name, '#', ' ') AS entity, unnest(['Account balance', 'Market segment', 'Nation']) AS column_name, unnest([c_acctbal::DECIMAL(15, 2)::VARCHAR, c_mktsegment, n_name]) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_PCELLS = """pcells AS (SELECT p_partkey AS row_index, p_name AS entity, unnest(['Retail price', 'Brand', 'Size']) AS column_name, unnest([p_retailprice::DECIMAL(15, 2)::VARCHAR, p_brand, p_size::VARCHAR]) AS value FROM part)"""


@add(f"WITH {_CELLS} SELECT row_index, entity, lower(entity) AS entity_norm, column_name, lower(column_name) AS column_norm, value FROM cells")
def cells_unpivot(spark, sf_dir):
    return _customers(spark, sf_dir).drop("table_id", "table_title")


@add("""WITH t AS (SELECT p_size AS table_id, p_partkey AS row_index, 'PRT' || lpad(p_partkey::VARCHAR, 6, '0') AS a, p_name AS b, p_brand AS c FROM part)
    SELECT table_id, row_index, a AS entity, lower(a) AS entity_norm, unnest(['Part', 'Brand']) AS column_name, unnest(['part', 'brand']) AS column_norm, unnest([b, c]) AS value FROM t WHERE (SELECT count(*) FROM part q WHERE q.p_size = table_id) >= 3
    UNION ALL SELECT table_id, row_index, b, lower(b), unnest(['Code', 'Brand']), unnest(['code', 'brand']), unnest([a, c]) FROM t WHERE (SELECT count(*) FROM part q WHERE q.p_size = table_id) >= 3
    UNION ALL SELECT table_id, row_index, a, lower(a), unnest(['Part', 'Brand']), unnest(['part', 'brand']), unnest([b, c]) FROM t WHERE (SELECT count(*) FROM part q WHERE q.p_size = table_id) < 3""")
def cells_alias(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("PRT"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    rows = p.select(F.col("p_size").alias("table_id"), F.col("p_partkey").alias("row_index"), F.array(F.lit("Code"), F.lit("Part"), F.lit("Brand")).alias("header"), F.array(code, "p_name", "p_brand").alias("cells"))
    return facts.alias_cells(rows)


@add(f"""WITH {_CELLS}, b AS (SELECT 'column' AS kind, lower(column_name) AS norm, column_name AS display, row_index FROM cells UNION ALL SELECT 'entity', lower(entity), entity, row_index FROM cells)
    SELECT kind, norm, first(display ORDER BY row_index, display) AS display, 'customer' AS table_ids FROM b GROUP BY kind, norm""")
def vocabulary(spark, sf_dir):
    return facts.vocabulary(_customers(spark, sf_dir)).withColumn("table_ids", F.array_join("table_ids", ","))


@add(f"""WITH {_CELLS}, {_PCELLS}, p AS (SELECT c_custkey AS query_id, lower(replace(c_name, '#', ' ')) AS e FROM customer WHERE c_custkey % 100 = 0),
    h AS (SELECT query_id, count(value) AS n_rows, min(value) AS v FROM p LEFT JOIN cells ON lower(entity) = e AND column_name = 'Nation' GROUP BY query_id)
    SELECT query_id, CASE n_rows WHEN 1 THEN 'confident' WHEN 0 THEN 'empty' ELSE 'ambiguous' END AS verdict, CASE n_rows WHEN 1 THEN v END AS value, n_rows FROM h""")
def cell_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").filter("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), text.normalise_label(F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))).alias("entity_norm"), F.lit("nation").alias("column_norm"))
    return facts.lookup(probes, _customers(spark, sf_dir))


@add(f"""WITH {_PCELLS}, p AS (SELECT p_partkey AS query_id, lower(p_name) AS e FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT -1, 'no such part'),
    h AS (SELECT query_id, count(value) AS n_rows, min(value) AS v FROM p LEFT JOIN pcells ON lower(entity) = e AND column_name = 'Brand' GROUP BY query_id)
    SELECT query_id, CASE n_rows WHEN 1 THEN 'confident' WHEN 0 THEN 'empty' ELSE 'ambiguous' END AS verdict, CASE n_rows WHEN 1 THEN v END AS value, n_rows FROM h""")
def cell_lookup_ambiguous(spark, sf_dir):
    probes = table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("entity_norm"))
    probes = probes.unionByName(spark.createDataFrame([(-1, "no such part")], "query_id long, entity_norm string")).withColumn("column_norm", F.lit("brand"))
    return facts.lookup(probes, _parts(spark, sf_dir))


@add(f"""WITH {_CELLS}, b AS (SELECT *, value::DOUBLE AS n, max(value::DOUBLE) OVER () AS top FROM cells WHERE column_name = 'Account balance')
    SELECT 1 AS query_id, 'confident' AS verdict, entity, value, 'Customers' AS table_title, 1::BIGINT AS n_winners, 'EXACT FACT: ' || entity || ' — Account balance: ' || value || ' (source: Customers)' AS fact FROM b WHERE n = top""")
def fact_max(spark, sf_dir):
    """Which customer has the highest account balance, from the question's words to the cited fact."""
    all_cells = _customers(spark, sf_dir)
    asked = spark.createDataFrame([(1, "which customer has the highest account balance")], "query_id int, text string")
    column = facts.resolve_exact(facts.variants(facts.spans(asked)), facts.vocabulary(all_cells).filter("kind = 'column'"))
    named = asked.join(column.select("query_id", F.col("span").alias("column_span"), F.col("norm").alias("column_norm")), "query_id").withColumn("entity_score", F.lit(0.0))
    probe = facts.aggregate_intent(named).filter("kind IN ('max', 'min')").select("query_id", "column_norm", "kind")
    return facts.render(facts.extreme(probe, all_cells), "Account balance")


@add(f"""WITH {_PCELLS}, b AS (SELECT value::DOUBLE AS n, value, entity FROM pcells WHERE column_name = 'Retail price'), m AS (SELECT min(n) AS lo, max(n) AS hi FROM b)
    SELECT q.query_id::INTEGER AS query_id, CASE count(*) WHEN 1 THEN 'confident' ELSE 'ambiguous' END AS verdict, CASE count(*) WHEN 1 THEN min(entity) END AS entity, CASE count(*) WHEN 1 THEN min(value) END AS value, CASE count(*) WHEN 1 THEN 'Parts' END AS table_title, count(*) AS n_winners
    FROM (VALUES (1, 'min'), (2, 'max')) q(query_id, kind), b, m WHERE n = CASE q.kind WHEN 'min' THEN lo ELSE hi END GROUP BY q.query_id""")
def fact_min_tie(spark, sf_dir):
    probes = spark.createDataFrame([(1, "retail price", "min"), (2, "retail price", "max")], "query_id int, column_norm string, kind string")
    return facts.extreme(probes, _parts(spark, sf_dir))


def _beyond(spark, rows):
    return spark.createDataFrame(rows, "query_id int, column_norm string, kind string, comparator string, threshold double")


@add(f"""WITH {_CELLS} SELECT q.query_id::INTEGER AS query_id, 'confident' AS verdict, count(*) FILTER (WHERE CASE op WHEN '>' THEN value::DOUBLE > t ELSE value::DOUBLE < t END) AS n_rows, NULL::VARCHAR AS entities
    FROM (VALUES (1, '>', 5000.0), (2, '<', 0.0)) q(query_id, op, t), cells WHERE column_name = 'Account balance' GROUP BY q.query_id""")
def fact_count(spark, sf_dir):
    return facts.beyond(_beyond(spark, [(1, "account balance", "count", ">", 5000.0), (2, "account balance", "count", "<", 0.0)]), _customers(spark, sf_dir)).withColumn("entities", F.array_join("entities", ";"))


@add(f"""WITH {_CELLS}, h AS (SELECT q.query_id, entity FROM (VALUES (1, 9950.0), (2, 100.0), (3, 1e9)) q(query_id, t) LEFT JOIN cells ON column_name = 'Account balance' AND value::DOUBLE > t)
    SELECT query_id::INTEGER AS query_id, CASE WHEN count(entity) > 20 THEN 'ambiguous' WHEN count(entity) = 0 THEN 'empty' ELSE 'confident' END AS verdict, count(entity) AS n_rows, CASE WHEN count(entity) BETWEEN 1 AND 20 THEN string_agg(entity, ';' ORDER BY entity) END AS entities FROM h GROUP BY query_id""")
def fact_filter(spark, sf_dir):
    rows = [(1, "account balance", "filter", ">", 9950.0), (2, "account balance", "filter", ">", 100.0), (3, "account balance", "filter", ">", 1e9)]
    return facts.beyond(_beyond(spark, rows), _customers(spark, sf_dir)).withColumn("entities", F.array_join("entities", ";"))


@add(r"""WITH c AS (SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS label FROM customer), q AS (SELECT c_custkey AS query_id, 'costumer ' || regexp_extract(label, '\d+') AS span FROM c WHERE c_custkey % 100 = 0)
    SELECT query_id, span, label FROM q JOIN c ON regexp_extract_all(span, '\d+') = regexp_extract_all(label, '\d+')""")
def digit_guard_join(spark, sf_dir):
    """Misspelt names meet the rows with the same digits only."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))).alias("label"))
    asked = c.filter("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("costumer "), F.regexp_extract("label", r"\d+", 0)).alias("span"))
    key = lambda df, col: df.withColumn("_d", F.array_join(facts.digit_runs(F.col(col)), "|"))
    return key(asked, "span").join(key(c, "label"), "_d").select("query_id", "span", "label")


_ASKED = [(1, "which customer has the highest account balance"), (2, "what is the market segment of custmer 000000042"), (3, "how many customers have an account balance above 5000"), (4, "list every nation of customer 000000007"), (5, "what is the acount balance of customer 000000010"), (6, "tell me a story")]


@add()
def fuzzy_resolve(spark, sf_dir):
    """Columns and customers that six questions name, misspelt or not."""
    asked = spark.createDataFrame(_ASKED, "query_id int, text string")
    words = settled(facts.vocabulary(_customers(spark, sf_dir)))
    every = settled(facts.variants(facts.spans(asked)))
    out = [facts.resolve(every, words.filter(F.col("kind") == kind)).withColumn("kind", F.lit(kind)) for kind in ("column", "entity")]
    return out[0].unionByName(out[1]).select("query_id", "kind", "span", "norm", "score")


@add()
def fact_ask(spark, sf_dir):
    """The whole path from six questions to verdicts."""
    return facts.ask(spark.createDataFrame(_ASKED, "query_id int, text string"), _customers(spark, sf_dir))


@add(r"""WITH t AS (SELECT conv_id * 1000 + turn AS query_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._''\-/%]*'), lambda x: regexp_replace(x, '''s$|''$', '')), lambda x: x <> '') AS t FROM conversations),
    n AS (SELECT query_id, t, unnest([1, 2, 3, 4]) AS n FROM t), p AS (SELECT query_id, t, n, unnest(range(0, len(t) - n + 1)) AS s FROM n WHERE len(t) >= n)
    SELECT query_id, array_to_string(t[s + 1:s + n], ' ') AS span, s::INTEGER AS start, (s + n)::INTEGER AS "end" FROM p""")
def spans(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return facts.spans(asked)


@add(r"""SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '(-?\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS number FROM documents""")
def leading_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.leading_number(F.col("text")).alias("number"))


_STRIP = r"regexp_replace(text, '(?m)^\s*(?:[-*+]\s+|#{1,6}\s+)?\d+[.)]\s+', '', 'g')"
_CLAIMS = rf"""list_concat(list_filter(list_transform(regexp_extract_all({_STRIP}, '\b\d[\d,.]*\b'), lambda x: regexp_replace(replace(x, ',', ''), '\.+$', '')), lambda x: x <> ''),
    list_transform(regexp_extract_all({_STRIP}, '\b[A-Z]{{1,4}}-\d{{1,4}}\b|\bAES-?\d{{3}}\b|\bTLS\s?\d\.\d\b'), lambda x: upper(replace(x, ' ', ''))))"""


@add(f"""WITH d AS (SELECT source, doc_id, text FROM documents), a AS (SELECT source, unnest({_CLAIMS}) AS claim FROM d WHERE doc_id % 2 = 0), b AS (SELECT source, unnest({_CLAIMS}) AS claim FROM d WHERE doc_id % 2 = 1)
    SELECT DISTINCT a.source, a.claim FROM a ANTI JOIN b ON a.source = b.source AND a.claim = b.claim""")
def numeric_claims_unsupported(spark, sf_dir):
    """Figures in the even texts of a source that no odd one holds."""
    docs = table(spark, sf_dir, "documents")
    return ground.unsupported(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "source")


@add()
def prune_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    answers = docs.select("doc_id", "text")
    context = docs.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    return ground.prune(answers, ground.unsupported(answers, context, "doc_id"), "doc_id")


@add(r"""WITH u AS (SELECT doc_id % 40 AS item_id, doc_id, source, text FROM documents), w AS (SELECT u.item_id, doc_id, list_has_any(regexp_extract_all(lower(u.text), '[a-z0-9]{3,}'), regexp_extract_all(lower(b.text), '[a-z0-9]{3,}')) AS hit FROM u JOIN benchmark b USING (item_id))
    SELECT item_id, doc_id FROM w WHERE hit""")
def citation_filter(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "doc_id", "text")
    return ground.contributing(units, table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "doc_id")


@add(r"""WITH u AS (SELECT doc_id % 40 AS item_id, source, lang AS section FROM documents)
    SELECT item_id, count(DISTINCT (source, section)) AS n_places, count(DISTINCT source) AS n_sources, count(DISTINCT (source, section)) > 1 AS multi_hop FROM u GROUP BY item_id""")
def multi_hop_provenance(spark, sf_dir):
    from ..operators import context

    used = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "source", F.col("lang").alias("section"))
    return context.shared_provenance(used, "item_id")


@add(r"""WITH u AS (SELECT doc_id % 40 AS item_id, source, doc_id % 3 AS page, lang AS section, doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, page, section ORDER BY doc_id) AS n FROM u)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY doc_id))::INTEGER AS citation_no, source, page, section, CASE WHEN length(t) <= 260 THEN t ELSE regexp_replace(substr(t, 1, 260), '\s+\S*$', '') || '…' END AS snippet FROM f WHERE n = 1""")
def citations(spark, sf_dir):
    used = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "source", (F.col("doc_id") % 3).alias("page"), F.col("lang").alias("section"), "doc_id", "text")
    return ground.citations(used, "item_id", "doc_id")
