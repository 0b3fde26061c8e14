"""Sessions, library upkeep, contract checks, intents, evaluation and windows: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..operators import library
from .common import Registry, table

_r = Registry()
add = _r.add
QUERIES, ORACLE = _r.queries, _r.oracle


def _talk(spark, sf_dir):
    """Conversations as sessions and messages; turns of one conversation share their second in pairs."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = F.timestamp_add("SECOND", (F.col("conv_id") * 60 + F.floor(F.col("turn") / 2)).cast("int"), start)
    messages = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", at.alias("created_at"))
    sessions = c.select(F.col("conv_id").alias("session_id")).distinct().select("session_id", (F.col("session_id") % 5).alias("user_id"), F.timestamp_add("SECOND", (F.col("session_id") * 60).cast("int"), start).alias("created_at"))
    return sessions, messages


_TALK = """m AS (SELECT conv_id AS session_id, turn AS seq, role, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn // 2) AS created_at FROM conversations),
    s AS (SELECT DISTINCT conv_id AS session_id, conv_id % 5 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60) AS created_at FROM conversations)"""


@add(f"WITH {_TALK} SELECT session_id, coalesce(max(m.created_at), any_value(s.created_at)) AS last_activity, count(m.seq) AS n_messages FROM s LEFT JOIN m USING (session_id) GROUP BY session_id ORDER BY 2 DESC, 1 LIMIT 20")
def sessions_recent(spark, sf_dir):
    return library.sessions(*_talk(spark, sf_dir), most=20)


@add(f"WITH {_TALK} SELECT m.*, (row_number() OVER (PARTITION BY session_id ORDER BY m.created_at, seq))::INTEGER AS position FROM m JOIN s USING (session_id) WHERE user_id = 2")
def session_messages(spark, sf_dir):
    sessions, messages = _talk(spark, sf_dir)
    return library.session_messages(messages, sessions, 2)


@add(f"""WITH {_TALK}, l AS (SELECT s.session_id, user_id, max(m.created_at) AS last_activity FROM s JOIN m USING (session_id) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_activity DESC, session_id) AS n FROM l)
    SELECT session_id, user_id, last_activity FROM n WHERE n <= 5""")
def prune_sessions(spark, sf_dir):
    sessions, messages = _talk(spark, sf_dir)
    return library.keep_recent(library.sessions(sessions, messages).join(sessions.select("session_id", "user_id"), "session_id").select("session_id", "user_id", "last_activity"), 5)


@add("""WITH l AS (SELECT n.n_nationkey AS document_id, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 100 END AS size_bytes, count(c_custkey) AS n_chunks FROM nation n LEFT JOIN customer c ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT count(*) AS n_documents, sum(n_chunks)::BIGINT AS n_chunks, sum(size_bytes)::BIGINT AS known_bytes, count(*) FILTER (WHERE size_bytes IS NULL) AS n_unknown FROM l""")
def document_list_totals(spark, sf_dir):
    documents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") * 100).alias("size_bytes"))
    chunks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document_id"))
    return library.list_totals(library.document_list(documents, chunks, "document_id"))


@add("WITH i AS (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256(text || ' changed') FROM documents WHERE doc_id % 3 = 0) SELECT d.doc_id, sha256(d.text) AS content_hash FROM documents d ANTI JOIN i ON d.doc_id = i.doc_id AND sha256(d.text) = i.content_hash")
def incremental_hash_skip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return library.needs_ingest(docs, library.content_hash(changed), "doc_id").select("doc_id", "content_hash")


@add("SELECT source, doc_id, n_chars FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source, doc_id, n_chars + 1 FROM documents WHERE source = 'src1' AND n_chars > 200")
def replace_source(spark, sf_dir):
    """src1 comes in again without its short rows, src2 with none."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    new = docs.filter("source = 'src1' AND n_chars > 200").withColumn("n_chars", F.col("n_chars") + 1)
    return library.replace(docs, new, ["source"], also=spark.createDataFrame([("src2",)], "source string"))


@add("""SELECT 'chunks' AS name, count(*) AS n FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 <> 3""")
def cascade_delete(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    left = library.cascade_delete({"chunks": docs.select("doc_id"), "labels": labels.select("doc_id")}, docs.filter("doc_id % 10 = 3"), "doc_id")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@add("""SELECT coalesce(n_nationkey, k) AS document_id, coalesce(n, n_nationkey)::BIGINT AS size_bytes FROM nation
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) ON n_nationkey = k""")
def upsert_documents(spark, sf_dir):
    """Nations as documents; those with suppliers get a new size."""
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document_id"), F.col("n_nationkey").cast("long").alias("size_bytes"))
    new = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("document_id")).agg(F.count("*").alias("size_bytes"))
    return library.upsert(old, new, ["document_id"], ["size_bytes"])


def _loose(spark, sf_dir):
    """Documents as chunks that break the contract here and there."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select("doc_id", F.when(k % 11 != 0, F.col("source")).alias("source"), F.when(k % 5 == 0, "x").otherwise((k % 9).cast("string")).alias("page"), F.when(k % 7 == 0, "letter").otherwise("policy").alias("content_type"), F.when(k % 2 == 0, "a, b").alias("topics"))


@add("""SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN source ELSE '' END AS source, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 9 END::INTEGER AS page, CASE WHEN doc_id % 7 = 0 THEN 'letter' ELSE 'policy' END AS content_type, CASE WHEN doc_id % 2 = 0 THEN 'a, b' ELSE '' END AS topics, 'text' AS extraction_mode FROM documents""")
def defaults_apply(spark, sf_dir):
    out = schema.apply_defaults(_loose(spark, sf_dir))
    return out.select("doc_id", "source", "page", "content_type", schema.join_list(F.col("topics")).alias("topics"), "extraction_mode")


@add("SELECT doc_id, 'content_type' AS field, 'unknown value' AS problem FROM documents WHERE doc_id % 7 = 0")
def contract_validate(spark, sf_dir):
    return schema.violations(schema.apply_defaults(_loose(spark, sf_dir)), "doc_id")


@add("SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_sources FROM documents")
def collection_stats(spark, sf_dir):
    return library.collection_stats(table(spark, sf_dir, "documents"))


@add("WITH t AS (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))::INTEGER AS t FROM documents) SELECT min(t) AS least, median(t)::DOUBLE AS median, max(t) AS most FROM t")
def chunk_token_stats(spark, sf_dir):
    return library.chunk_stats(table(spark, sf_dir, "documents"))


def _results(spark, sf_dir):
    """Labels as results of an evaluation: quality is a pass, the share of letters its similarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), "n_chars", "text")
    letters = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "category", (F.col("quality") == 1).alias("passed"), F.round(letters, 6).alias("similarity"), (F.col("toxic") == 1).alias("toxic"))


_RESULTS = "r AS (SELECT doc_id, source AS category, quality = 1 AS passed, round(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / greatest(length(text), 1), 6) AS similarity FROM labels JOIN documents USING (doc_id))"


@add(f"WITH {_RESULTS} SELECT category, count(*) AS total, count(*) FILTER (WHERE passed) AS n_passed, round(avg(passed::INTEGER::DOUBLE), 6) AS pass_rate, round(avg(similarity), 6) AS mean_similarity FROM r GROUP BY category ORDER BY pass_rate, category")
def eval_by_category(spark, sf_dir):
    return library.weakest_first(library.summary(_results(spark, sf_dir), ["category"]))


@add(f"WITH {_RESULTS} SELECT doc_id, category, similarity FROM r WHERE NOT passed")
def eval_failures(spark, sf_dir):
    return _results(spark, sf_dir).filter(~F.col("passed")).select("doc_id", "category", "similarity")


@add(f"""WITH {_RESULTS} SELECT passed, count(*) AS n, round(min(similarity), 6) AS least, round(max(similarity), 6) AS most, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.05), 6) AS p05, round(quantile_cont(similarity, 0.95), 6) AS p95 FROM r GROUP BY passed""")
def calibration_stats(spark, sf_dir):
    return library.calibration(_results(spark, sf_dir), "passed")


@add(f"WITH {_RESULTS} SELECT category, count(*) AS n, count(*) >= 20 AS enough FROM r GROUP BY category")
def gold_set_overview(spark, sf_dir):
    return library.below_minimum(_results(spark, sf_dir), 20)


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in text.INTENT_PATTERNS.items()) + " END"
_ENGLISH = f"(len(regexp_extract_all(lower(text), '[a-z'']+')) < 4 OR list_has_any(regexp_extract_all(lower(text), '[a-z'']+'), {_sql_list(text.ENGLISH_FUNCTION_WORDS)}))"
_ENTITY = rf"len(list_filter(regexp_extract_all(text, '\b[A-Z][a-zA-Z]{{2,}}(?:\s+[A-Z][a-zA-Z]{{2,}})*\b'), lambda r: string_split_regex(r, '\s+')[1] <> regexp_replace(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1], '^[?,.]+|[?,.]+$', '', 'g') AND NOT list_contains({_sql_list(text.COMMON_CAPITALISED)}, r))) > 0"


@add(rf"""SELECT conv_id, turn, coalesce({_INTENT}, 'fact_lookup') AS intent, {_ENGLISH} AS english, {_ENTITY} AS entity,
    length(text) <= 140 AND length(text) - length(replace(text, '?', '')) <= 1 AND NOT contains(lower(text), ' and ') AND NOT ({_ENTITY}) AND {_ENGLISH} AND {_INTENT} IS NULL AS simple FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM conversations)""")
def intent_classify(spark, sf_dir):
    # the patterns' word edges differ between engines beyond ASCII
    q = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.query_type(q).alias("intent"), text.looks_english(q).alias("english"), text.mentions_entity(q).alias("entity"), text.looks_simple(q).alias("simple"))


@add(rf"""WITH k AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]+'), lambda x: lower(x)), lambda w: NOT list_contains({_sql_list(text.STOPWORDS)}, w) AND length(w) > 2) AS w, regexp_extract_all(text, '{text.RARE_TOKEN}') AS r FROM conversations),
    b AS (SELECT conv_id, turn, list_concat(r, w) AS b FROM k)
    SELECT conv_id, turn, array_to_string(list_filter(b, lambda x, i: list_position(list_transform(b, lambda y: lower(y)), lower(x)) = i), ' ') AS keywords FROM b""")
def keyword_extract(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


# ---------------------------------------------------------------- windows over events (an extra)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@add("WITH e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS window_start, event_type FROM events) SELECT window_start, event_type, count(*) AS n FROM e GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@add("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@add(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g'), '^[ .;,]+|[ .;,]+$', '', 'g')), lambda x: x <> '') AS v FROM documents)
    SELECT doc_id, array_to_string(list_filter(v, lambda x, i: length(x) > 120 OR list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)[1:8].list_transform(lambda x: x[1:120]), ' | ') AS labels FROM l""")
def label_cleaning(spark, sf_dir):
    """The lines of a document as labels: the first eight that differ."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.clean_labels(F.split("text", "\n"), 8), " | ").alias("labels"))
