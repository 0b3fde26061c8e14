"""Lines, headings, sections, chunks, tables over pages, manifests: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, geometry, manifest, structure
from .common import Registry, table

_r = Registry()
add = _r.add
QUERIES, ORACLE = _r.queries, _r.oracle

_TOK = "len(regexp_extract_all({c}, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))"
_LINES = """lines AS (SELECT doc_id, (unnest(range(0, len(l))))::INTEGER AS block_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@add(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, string_split(html, '><') AS l FROM pages),
    lines AS (SELECT page_id, host, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM p),
    m AS (SELECT page_id, host, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, row_number() OVER (PARTITION BY host, page_id ORDER BY line_no) AS u, row_number() OVER (PARTITION BY host, page_id ORDER BY line_no DESC) AS d FROM lines),
    n AS (SELECT host, count(DISTINCT page_id) AS n FROM p GROUP BY host)
    SELECT host, line, count(DISTINCT page_id) AS n_pages FROM m JOIN n USING (host) WHERE n >= 3 AND (u <= 2 OR d <= 3) AND length(line) <= 120 AND line <> '' GROUP BY host, line, n HAVING count(DISTINCT page_id) >= greatest(2, floor(n * 0.6))""")
def running_line_filter(spark, sf_dir):
    """Margin lines that come back on most pages of a host; a tag is a line."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.posexplode(F.split("html", "><")).alias("line_no", "line"))
    return structure.running_lines(pages, "host", "page_id")


_HEADING = r"""length(line) > 0 AND length(line) <= 90 AND CASE WHEN regexp_matches(line, '^\d+(?:\.\d+)*\.?\s+\S.{0,80}$') THEN NOT ends_with(line, '.') OR len(w) <= 6
    ELSE NOT regexp_matches(line, '[.:;,]$') AND NOT regexp_matches(line, '\bP[1-4]\b.*\d+-\s*$') AND len(w) BETWEEN 1 AND 12
         AND ((regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}')) OR len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) >= greatest(2, len(w) - 1)) END"""


@add(f"WITH {_LINES}, w AS (SELECT *, string_split_regex(trim(line), '\\s+') AS w FROM lines) SELECT doc_id, block_no, line FROM w WHERE {_HEADING}")
def heading_detect(spark, sf_dir):
    lines = structure.blocks(table(spark, sf_dir, "documents"), "doc_id")
    return lines.filter(text.is_heading(F.col("line")))


@add("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_carry_forward(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return structure.carry_forward(turns, "conv_id", "turn", F.col("role") == "user", F.col("turn")).select("conv_id", "turn", "section")


@add("""WITH t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations),
    r AS (SELECT *, sum(c::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS run_no FROM t)
    SELECT conv_id, run_no::BIGINT AS run_no, role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY ALL""")
def section_runs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    changed = ~F.col("role").eqNullSafe(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return structure.runs(turns, "conv_id", "turn", changed).groupBy("conv_id", "run_no", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@add("SELECT source, doc_id, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbour_links(spark, sf_dir):
    return structure.links(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "doc_id")


_PACK = """RECURSIVE {cte}, k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM src),
    f AS (SELECT {by}, {order}, tokens, k, 0 AS g, tokens AS used, 1 AS n FROM k WHERE k = 1
          UNION ALL SELECT k.{by}, k.{order}, k.tokens, k.k, CASE WHEN {full} THEN f.g + 1 ELSE f.g END, CASE WHEN {full} THEN k.tokens ELSE f.used + k.tokens END, CASE WHEN {full} THEN 1 ELSE f.n + 1 END
          FROM f JOIN k ON k.{by} = f.{by} AND k.k = f.k + 1)"""


@add("WITH " + _PACK.format(cte=f"{_LINES}, src AS (SELECT doc_id, block_no, {_TOK.format(c='line')} AS tokens FROM lines)", by="doc_id", order="block_no", full="f.used + k.tokens > 350") + """
    SELECT f.doc_id, f.g AS chunk_no, string_agg(l.line, chr(10) ORDER BY f.block_no) AS text, count(*) AS n_blocks, sum(f.tokens)::BIGINT AS tokens FROM f JOIN lines l USING (doc_id, block_no) GROUP BY ALL""")
def chunk_pack(spark, sf_dir):
    lines = structure.blocks(table(spark, sf_dir, "documents"), "doc_id")
    return structure.pack_blocks(lines, ["doc_id"], "block_no", "line", 350)


@add("WITH " + _PACK.format(cte="src AS (SELECT p_size, p_partkey, len(regexp_extract_all(p_name || ' | ' || p_type, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS tokens FROM part)", by="p_size", order="p_partkey", full="(f.used + k.tokens > 60 OR f.n >= 10)") + """
    SELECT p_size, g AS chunk_no, count(*) AS n_blocks, sum(tokens)::BIGINT AS tokens FROM f GROUP BY ALL""")
def row_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_size", "p_partkey", F.concat_ws(" | ", "p_name", "p_type").alias("line"))
    return structure.pack_blocks(rows, ["p_size"], "p_partkey", "line", 60, 10).drop("text")


@add("""WITH c AS (SELECT source, doc_id, (doc_id // 10)::BIGINT AS page, 0 AS k FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT source, doc_id, doc_id // 10, 1 FROM documents WHERE doc_id % 7 = 0)
    SELECT source, doc_id, page, (row_number() OVER (PARTITION BY source ORDER BY page, k, doc_id) - 1)::INTEGER AS chunk_index FROM c""")
def splice_by_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 10).alias("page"))
    return structure.splice(docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 7 = 0"), "source", "doc_id", "page")


_FRAGMENTS = """f AS (SELECT o_custkey AS doc, o_orderkey AS fragment_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 2 AS width, o_orderkey % 3 <> 0 AS last_on_page, o_orderkey % 5 <> 0 AS first_on_page FROM orders)"""


@add(f"""WITH {_FRAGMENTS}, m AS (SELECT *, CASE WHEN page = lag(page) OVER w + 1 AND width = lag(width) OVER w AND lag(last_on_page) OVER w AND first_on_page THEN 0 ELSE 1 END AS n FROM f WINDOW w AS (PARTITION BY doc ORDER BY page, fragment_no)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY page, fragment_no) - 1 AS table_no FROM m)
    SELECT doc, table_no::BIGINT AS table_no, min(page)::INTEGER AS page_start, max(page)::INTEGER AS page_end, count(*) AS fragments FROM s GROUP BY ALL""")
def stitch_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    fragments = o.select(F.col("o_custkey").alias("doc"), k.alias("fragment_no"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), (k % 2).alias("width"), (k % 3 != 0).alias("last_on_page"), (k % 5 != 0).alias("first_on_page"))
    return structure.stitch(fragments, "doc").groupBy("doc", "table_no").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("fragments"))


@add("""WITH l AS (SELECT *, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS level, string_split(text, chr(10))[1] AS title FROM conversations),
    h AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN title WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS h2 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, array_to_string(list_filter([coalesce(h1, ''), coalesce(h2, '')], lambda x: x <> ''), ' > ') AS heading_path FROM h""")
def heading_paths(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("level", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2)).withColumn("title", F.get(F.split("text", "\n"), F.lit(0)))
    return structure.heading_levels(turns, "conv_id", "turn", "level", "title").select("conv_id", "turn", "heading_path")


_PAGES = r"""tree AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title,
    array_to_string(list_filter(string_split(regexp_extract(url, '^https?://([^?#]+)', 1), '/'), lambda x: x <> ''), ' > ') AS path FROM pages)"""


def _pages(spark, sf_dir):
    parts = F.filter(F.split(F.regexp_extract("url", r"^https?://([^?#]+)", 1), "/"), lambda x: x != "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.array_join(parts, " > ").alias("path"))


@add(f"WITH {_PAGES} SELECT host, path, min(page_id) AS page, first(title ORDER BY page_id) AS title FROM tree GROUP BY host, path")
def outline_min_page(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("host", "path").agg(F.min("page_id").alias("page"), F.min_by("title", "page_id").alias("title"))


@add(f"""WITH {_PAGES}, g AS (SELECT host, path, min(page_id) AS page, max(page_id) AS page_end, count(*) AS n_chunks, len(string_split(path, ' > '))::INTEGER AS level FROM tree GROUP BY host, path)
    SELECT *, (row_number() OVER (PARTITION BY host ORDER BY page, path))::INTEGER AS position FROM g""")
def heading_tree(spark, sf_dir):
    return manifest.heading_tree(_pages(spark, sf_dir), "host", "path", "page_id", "page_id")


_NAV = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)"


@add(f"""WITH l AS (SELECT page_id, unnest(range(0, len(a))) AS k, '- ' || unnest(a) || ': see page' AS line FROM (SELECT page_id, {_NAV} AS a FROM pages)),
    i AS (SELECT page_id, k, trim(regexp_replace(CASE WHEN regexp_extract(b, '^([^:–-]{{2,60}})\\s*[:–-]\\s+\\S', 1) <> '' THEN regexp_extract(b, '^([^:–-]{{2,60}})\\s*[:–-]\\s+\\S', 1) ELSE b END, '\\s+', ' ', 'g')) AS item
          FROM (SELECT page_id, k, regexp_extract(line, '(?i)^\\s*(?:[-•*+]|\\(?\\d{{1,2}}[.)]|\\(?[a-z][.)])\\s+(\\S.{{2,120}}?)\\s*$', 1) AS b FROM l)),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(item) ORDER BY k) AS n FROM i WHERE item <> '' AND len(string_split(item, ' ')) <= 10),
    o AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k))::INTEGER AS item_no, item FROM f WHERE n = 1)
    SELECT * FROM o WHERE item_no <= 12""")
def list_items(spark, sf_dir):
    names = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a></li>'), F.lit(1))
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(names).alias("k", "a")).select("page_id", "k", F.concat(F.lit("- "), "a", F.lit(": see page")).alias("line"))
    return manifest.list_items(lines, "page_id", "k")


@add("""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS label FROM documents),
    n AS (SELECT source, label, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, label) AS rank FROM t GROUP BY source, label)
    SELECT source, label, n, rank::INTEGER AS rank FROM n WHERE rank <= 40""")
def label_frequency_topn(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("source", F.explode(text.bm25_tokens(F.col("text"))).alias("label"))
    return manifest.frequent_labels(tokens, "source", "label")


_LISTS = [(1, "list every widget"), (2, "what are all the blue bolts"), (3, "which kinds of ring exist")]


@add()
def enumeration_plan(spark, sf_dir):
    """Part names grouped by their noun; three questions ask for a set."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    items = p.select(F.get(F.reverse(F.split("p_name", " ")), F.lit(0)).alias("group_label"), F.col("p_name").alias("item"))
    asked = spark.createDataFrame(_LISTS, "query_id int, text string").select("query_id", F.explode(manifest.enumeration_terms(F.col("text"))).alias("term"))
    return manifest.enumeration_plan(asked, items)


@add(r"""WITH i AS (SELECT p_brand AS document_id, p_name AS item FROM part WHERE NOT regexp_matches(p_name, '(?i)\b(?:types?|kinds?)\s+of\b')),
    t(query_id, term, words) AS (VALUES (1, 'widget', 1), (2, 'blue bolt', 2), (2, 'blue', 1), (2, 'bolt', 1), (3, 'ring', 1)),
    h AS (SELECT t.*, i.* FROM t JOIN i ON list_bool_and(list_transform(string_split(term, ' '), lambda w: regexp_matches(lower(trim(item)), '\b' || w || '(?:s|es|ies)?\b')))),
    c AS (SELECT query_id, term, document_id, count(*) AS n FROM h GROUP BY ALL),
    n AS (SELECT query_id, term, document_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY n DESC, document_id) = 1),
    p AS (SELECT DISTINCT h.query_id, h.term, h.words, h.document_id, lower(trim(regexp_replace(string_split_regex(item, '\s*[-–]\s*')[1], '\s+', ' ', 'g'))) AS item FROM h JOIN n USING (query_id, term, document_id)),
    s AS (SELECT query_id, term, document_id, count(*) AS n, round(0.5::DOUBLE * count(*) + 0.25 * any_value(words), 6) AS score FROM p GROUP BY ALL HAVING count(*) >= 2)
    SELECT query_id, term, document_id, score, least(n, 25)::BIGINT AS n_items, CASE WHEN n > 25 THEN n ELSE 0 END::BIGINT AS truncated_from FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) = 1""")
def enumeration_union(spark, sf_dir):
    """Part names that a term names anywhere in one brand, whatever their group."""
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("document_id"), F.col("p_name").alias("item"))
    asked = spark.createDataFrame(_LISTS, "query_id int, text string").select("query_id", F.explode(manifest.enumeration_terms(F.col("text"))).alias("term"))
    return manifest.union_plan(asked, items).drop("items")


@add(r"""WITH p AS (SELECT DISTINCT p_name AS heading_path FROM part),
    q(query_id, name, also) AS (VALUES (1, 'red', 'widget'), (2, 'blue', 'bolt'), (3, 'widget', 'widget'))
    SELECT query_id::INTEGER AS query_id, heading_path FROM q JOIN p ON regexp_matches(lower(heading_path), '\b' || name || '(?:s|es|ies)?\b') AND regexp_matches(lower(heading_path), '\b' || also || '(?:s|es|ies)?\b') QUALIFY count(*) OVER (PARTITION BY query_id) <= greatest(1, floor((SELECT count(*) FROM p) * 0.5))""")
def heading_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.col("p_name").alias("heading_path")).distinct()
    asked = spark.createDataFrame([(1, "what does the red widget section say"), (2, "section on blue bolt please"), (3, "in the widget section")], "query_id int, text string")
    return manifest.heading_filter(asked, paths)


@add(r"""WITH a AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS hay FROM documents),
    e AS (SELECT DISTINCT lower(p_name) AS item, p_partkey AS doc_id FROM part)
    SELECT doc_id, item FROM a JOIN e USING (doc_id) WHERE NOT (contains(hay, item) OR len(list_filter(string_split(item, ' '), lambda w: NOT regexp_matches(hay, '\b' || w || '\b'))) = 0)""")
def coverage_missing(spark, sf_dir):
    """Which names expected of each text it leaves out; every part is expected in the text with its number."""
    expected = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("item")).distinct()
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    return manifest.missing_items(expected, answers).withColumnRenamed("query_id", "doc_id")


@add(r"""WITH o AS (SELECT source, lang AS section, min(doc_id) AS opener, count(*) AS n FROM documents GROUP BY ALL), present AS (SELECT DISTINCT source, lang AS section FROM documents WHERE doc_id % 100 = 0)
    SELECT o.* FROM o ANTI JOIN present p ON o.source = p.source AND o.section = p.section""")
def section_coverage_gap(spark, sf_dir):
    from ..operators import context

    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("section"), "doc_id")
    openers = docs.groupBy("source", "section").agg(F.min("doc_id").alias("opener"), F.count("*").alias("n"))
    return context.section_coverage(openers, docs.filter("doc_id % 100 = 0"), "source", "section")


@add(r"""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS block_no, min(l_quantity) AS x0, min(l_quantity) + 10 AS x1, l_linenumber * 5.0 AS y0, l_linenumber * 5.0 + 5 AS y1 FROM lineitem GROUP BY ALL),
    r AS (SELECT o_orderkey AS page_id, 10.0 AS x0, 30.0 AS x1, 0.0 AS y0, 14.0 AS y1 FROM orders WHERE o_orderkey % 2 = 0)
    SELECT page_id, block_no FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page_id = b.page_id AND greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def uncovered_blocks(spark, sf_dir):
    n = F.col("l_linenumber") * 5.0
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    blocks = first.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("block_no"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), n.alias("y0"), (n + 5).alias("y1"))
    rects = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("page_id"), F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(14.0).alias("y1"))
    return structure.uncovered_blocks(blocks, rects, ["page_id"]).select("page_id", "block_no")


def _chunks(spark, sf_dir):
    """Parents and children of all documents: lines as blocks, sections by headings."""
    lines = structure.blocks(table(spark, sf_dir, "documents"), "doc_id").withColumn("page", F.lit(1))
    marked = structure.runs(lines, "doc_id", "block_no", text.is_heading(F.col("line")), "section_no")
    return chunking.chunks(chunking.blocks_of(marked, "doc_id", "block_no"), "doc_id", "section_no", "block_no")


@add()
def parent_child_chunks(spark, sf_dir):
    """The chunks that are searched, with the parents that are read; tests compare with plain Python."""
    return _chunks(spark, sf_dir)[1].select("doc_id", "section_no", "parent_index", "chunk_index", "text", "has_table", "tokens", "prev_index", "next_index")


@add(rf"""WITH {_LINES} SELECT doc_id, sum({_TOK.format(c="line")})::BIGINT AS tokens FROM lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id""")
def parent_tokens(spark, sf_dir):
    """Parents hold every token of a document once."""
    return _chunks(spark, sf_dir)[0].groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))


#: Parts as printed tables: 40 rows a page and a header, columns at fixed places, each as wide as its text.
_COLUMNS = [("Part", 0.0, "'No ' || p_partkey"), ("Name", 90.0, "p_name"), ("Brand", 420.0, "p_brand")]


def _printed(spark, sf_dir):
    """Spans of all pages (page, row_no, column, x0, y0, x1, y1, text)."""
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("page"), (F.col("p_partkey") % 40 + 1).cast("int").alias("row_no"), *[F.expr(sql).alias(name) for name, _, sql in _COLUMNS])
    heads = parts.select("page").distinct().select("page", F.lit(0).alias("row_no"), *[F.lit(name).alias(name) for name, _, _ in _COLUMNS])
    cells = parts.unionByName(heads).select("page", "row_no", F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.lit(x).alias("x0"), F.col(name).alias("text")) for k, (name, x, _) in enumerate(_COLUMNS)])).alias("c"))
    return cells.select("page", "row_no", "c.column", "c.x0", (F.col("row_no") * 12.0).alias("y0"), (F.col("c.x0") + F.length("c.text") * 5).alias("x1"), (F.col("row_no") * 12.0 + 10).alias("y1"), "c.text")


_PRINTED = """printed AS (SELECT (p_partkey // 40)::INTEGER AS page, (p_partkey % 40 + 1)::INTEGER AS row_no, 'No ' || p_partkey AS a, p_name AS b, p_brand AS c FROM part),
    headed AS (SELECT * FROM printed UNION ALL SELECT DISTINCT page, 0, 'Part', 'Name', 'Brand' FROM printed)"""


@add(f"""WITH {_PRINTED} SELECT page, row_no, (unnest([0, 1, 2]))::INTEGER AS col_no, unnest([a, b, c]) AS text FROM headed""")
def table_from_positions(spark, sf_dir):
    """Rows and columns of printed tables from nothing but the places of their texts."""
    return geometry.grid(_printed(spark, sf_dir).drop("row_no", "column"), ["page"])


@add(f"""WITH {_PRINTED} SELECT page, row_no, a || '|' || b || '|' || c AS cells, true AS repaired FROM headed""")
def lost_columns(spark, sf_dir):
    """Tables that were found with their middle column only get the others back."""
    spans = _printed(spark, sf_dir)
    found = spans.filter(F.col("column") == 1)
    rows = found.select("page", F.lit(1).alias("table_no"), "row_no", "y0", "y1", F.array("text").alias("cells"))
    rects = found.groupBy("page").agg(F.lit(1).alias("table_no"), *[f("%s" % c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    out = geometry.recovered(rows, spans.drop("row_no", "column"), rects, ["page"])
    return out.select("page", "row_no", F.array_join("cells", "|").alias("cells"), "repaired")
