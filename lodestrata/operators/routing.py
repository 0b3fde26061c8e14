"""From a question to what is searched: plans, routing signals, a document lock, candidates by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import profiles
from ..functions import text
from . import rank

# Words that carry no routing evidence.
ROUTING_STOP = "a an and are as at be by can do does for from has have how in is it its many much must of on or our that the their there these this to was we what when where which who why will with you your all every list give explain".split()
# A document referred to without its name; a name or code; a wish to compare.
REFERENCE = r"(?i)\b(this|that|the above|the same|the aforementioned|said)\s+(document|policy|handbook|manual|guide|standard|sop|register|procedure)\b|\b(the (?:document|policy|handbook|manual|guide) (?:above|we just|i just|mentioned))\b"
ENTITY = r"\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b|\b[A-Z]{1,4}-\d{1,4}\b|\bTier\s?\d\b"
COMPARING = r"(?i)\b(compar\w*|differ\w*|versus|vs\.?|difference between|both (?:documents|policies|handbooks)|reconcile|across (?:all|our|the) (?:documents|policies))\b"
# Something to be built from several parts; a whole document.
COMBINING = r"(?i)\b(design|devise|construct|build|create|propose|put together|come up with)\b.{0,40}\b(workflow|process|plan|procedure|checklist|approach|strategy|programme|program|roadmap)\b|\bcombin\w+\b|\bend[- ]to[- ]end\b|\bwhat should (?:i|we) do\b|\bhow should (?:i|we) (?:approach|handle|structure|organise|organize)\b"
DOCUMENT_WIDE = r"(?i)\b(summar\w+|overview of|explain the (?:entire|whole|full)|walk me through the (?:entire|whole)|everything (?:in|about)|the (?:entire|whole|full) (?:document|policy|handbook|manual|guide|sop))\b"


# ---------------------------------------------------------------- plans


def plans(questions: DataFrame) -> DataFrame:
    """query_id, text, intent, n_entities and the retrieval profile of that kind of question (seven rows, broadcast)."""
    kind = questions.select("query_id", "text", text.query_type(F.col("text")).alias("intent"), F.size(entity_terms(F.col("text"))).alias("n_entities"))
    return kind.join(F.broadcast(profiles(questions.sparkSession)), "intent", "left")


def orchestration(question: Column, intent: Column) -> Column:
    """Which path a question takes: combining first, then a whole document, then a plain lookup."""
    wide = (intent == "synthesis") | question.rlike(DOCUMENT_WIDE)
    return F.when(question.rlike(COMBINING), "combination/workflow").when(wide, "document-wide").when(intent == "fact_lookup", "point-lookup").otherwise("other")


def query_set(plans_: DataFrame, subqueries: DataFrame) -> DataFrame:
    """query_id, text: the question itself and its parts (query_id, text), each text once in any case."""
    both = plans_.select("query_id", "text", F.lit(0).alias("_k")).unionByName(subqueries.select("query_id", "text", F.lit(1).alias("_k")))
    first = Window.partitionBy("query_id", text.normalise_context(F.col("text"))).orderBy("_k", "text")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("query_id", "text")


# ---------------------------------------------------------------- routing signals


def terms(value: Column) -> Column:
    """Content words in lower case, each once."""
    words = F.transform(F.regexp_extract_all(value, F.lit(r"[A-Za-z][A-Za-z0-9'-]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(ROUTING_STOP) & (F.length(w) > 2)))


def entity_terms(value: Column) -> Column:
    """Names, codes and tiers in lower case, each once."""
    found = F.transform(F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0)), lambda x: F.lower(text.strip(x)))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(ROUTING_STOP)))


def title_terms(title: Column, source: Column) -> Column:
    """Content words of a document's title and of its file name."""
    name = F.translate(F.regexp_replace(source, r"(?i)\.pdf$", ""), "_-", "  ")
    return F.array_union(terms(F.coalesce(title, F.lit(""))), terms(name))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _named(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents beside their question, with its words and whether it names them by all words of their title."""
    q = questions.select("query_id", F.col("text").alias("_q"), F.col("focus").alias("_focus"), terms(F.col("text")).alias("_qt"))
    both = documents.join(q, "query_id").withColumn("_title", title_terms(F.col("doc_title"), F.col("source")))
    return both.withColumn("_named", (F.size("_title") > 0) & (F.size(F.array_except("_title", "_qt")) == 0))


def signals(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """title, reference, focus and entity, each 0 to 1, for every routed document of a question.

    ``questions``: query_id, text, focus (the document last spoken of, or null); ``documents``:
    query_id, source, doc_title, top_sections (array) and whatever else, which is kept.
    """
    named = _named(questions, documents)
    in_focus = F.coalesce(F.col("_focus") == F.col("source"), F.lit(False))
    referred = F.col("_named") | (in_focus & F.col("_q").rlike(REFERENCE))
    asked = entity_terms(F.col("_q"))
    own = entity_terms(F.concat_ws(" ", F.coalesce("doc_title", F.lit("")), F.translate("source", "_", " "), F.array_join("top_sections", " ")))
    shared = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, own)) / F.size(asked)).otherwise(0.0)
    return named.select(*documents.columns, jaccard(F.col("_qt"), F.col("_title")).alias("title"), referred.cast("double").alias("reference"), in_focus.cast("double").alias("focus"), shared.alias("entity"))


def refined(questions: DataFrame, documents: DataFrame, weight: float = 0.35, protect: float = 0.85) -> DataFrame:
    """Scores of ``documents`` (with score) moved by the mean of the four signals; leaders aren't moved down."""
    return rank.refine_documents(signals(questions, documents), ["title", "reference", "focus", "entity"], weight, protect)


def document_lock(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, source of questions that may be answered from one document only.

    Exactly one document is named, or none is and the question refers back to the one in focus.
    A comparison is never locked.
    """
    referred = F.col("_q").rlike(REFERENCE)
    per = _named(questions, documents).filter(~F.col("_q").rlike(COMPARING)).groupBy("query_id").agg(
        F.count_if("_named").alias("_n"), F.min(F.when(F.col("_named"), F.col("source"))).alias("_one"), F.min(F.when(referred & (F.col("_focus") == F.col("source")), F.col("source"))).alias("_back")
    )
    return per.select("query_id", F.when(F.col("_n") == 1, F.col("_one")).when(F.col("_n") == 0, F.col("_back")).alias("source")).filter("source IS NOT NULL")


def search_scope(routed: DataFrame, locks: DataFrame, plans_: DataFrame) -> DataFrame:
    """query_id, source that a question searches: its lock, or the documents it is routed to; ungated plans search all (no rows)."""
    gated = plans_.filter("gated").select("query_id")
    locked = locks.join(gated, "query_id", "left_semi").select("query_id", "source")
    rest = routed.join(gated, "query_id", "left_semi").join(locked.select("query_id"), "query_id", "left_anti")
    return locked.unionByName(rest.select("query_id", "source"))


# ---------------------------------------------------------------- candidates by mode


def candidates(pool: DataFrame, plans_: DataFrame, key: str, section: str = "section", index: str = "chunk_index") -> DataFrame:
    """The pool of each question in the order that its plan's mode asks for: query_id, key, position.

    ``pool``: query_id, key, source, section, chunk_index, fused and, for plans by entity, the best
    ``entity_rank`` of a row within its entity's list (null: in none). An outline keeps two rows of
    a section, a sweep all rows in order of the document; other modes keep ``max_per_source`` of a
    document, and a plan by entity begins with the best rows of each entity.
    """
    rows = pool.join(plans_.select("query_id", "mode", "final_k", "max_per_source", F.coalesce("n_entities", F.lit(0)).alias("_e")), "query_id")
    by_entity = (F.col("mode") == "per_entity") & (F.col("_e") > 0)
    slots = F.greatest(F.lit(2), F.floor(F.col("final_k") / F.greatest(F.lit(1), F.col("_e"))))
    rows = rows.withColumn("_first", F.coalesce(by_entity & (F.col("entity_rank") <= slots), F.lit(False)))
    order = [F.desc("_first"), F.when(F.col("_first"), F.col("entity_rank")), F.desc("fused"), key]
    in_source = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))
    in_section = F.row_number().over(Window.partitionBy("query_id", "source", section).orderBy(F.desc("fused"), key))
    keep = F.when(F.col("mode") == "sweep", True).when(F.col("mode") == "outline", F.col("_in_section") <= 2).otherwise(F.col("_in_source") <= F.col("max_per_source"))
    kept = rows.withColumn("_in_source", in_source).withColumn("_in_section", in_section).filter(keep)
    sweep = F.col("mode") == "sweep"
    place = Window.partitionBy("query_id").orderBy(F.when(sweep, F.col("source")), F.when(sweep, F.col(index)), *order)
    return kept.withColumn("position", F.row_number().over(place)).select("query_id", key, "position")


def chosen(candidates_: DataFrame, plans_: DataFrame, key: str, guaranteed: DataFrame | None = None) -> DataFrame:
    """What of the candidates is used: query_id, key, rank.

    ``candidates_``: query_id, key, position, rerank (null: not judged), fused, source,
    chunk_index. A window of them counts: all in a sweep, else four times ``final_k``, ten more at
    least. A question counts as reranked if its window is larger than ``final_k`` and holds any
    judgement. Then rows that pass (or weren't judged) stay: all of them in order of the document
    in a sweep, else the best ``final_k``, and rows of ``guaranteed`` (query_id, key) that are
    not among these stand before them. Without reranking, or if nothing passes, the window's first
    ``final_k`` are used as they stand.
    """
    rows = candidates_.join(plans_.select("query_id", "mode", "final_k", "min_rerank"), "query_id")
    sweep, per = F.col("mode") == "sweep", Window.partitionBy("query_id")
    window = rows.filter(sweep | (F.col("position") <= F.greatest(F.col("final_k") * 4, F.col("final_k") + 10)))
    window = window.withColumn("_passes", F.col("rerank").isNull() | (F.col("rerank") >= F.col("min_rerank")))
    judged = F.max(F.col("rerank").isNotNull()).over(per) & (F.count("*").over(per) > F.col("final_k"))
    window = window.withColumn("_reranked", judged).withColumn("_any", F.col("_reranked") & F.max("_passes").over(per))
    left = window.filter(F.col("_passes") | ~F.col("_any"))
    by_document = sweep & F.col("_any")
    place = per.orderBy(F.when(by_document, F.col("source")), F.when(by_document, F.col("chunk_index")), F.when(F.col("_any"), F.coalesce("rerank", F.lit(0))).desc_nulls_last(), F.when(F.col("_any"), F.col("fused")).desc_nulls_last(), "position")
    out = left.withColumn("rank", F.row_number().over(place)).filter(by_document | (F.col("rank") <= F.col("final_k")))
    if guaranteed is None:
        return out.select("query_id", key, "rank")
    # a judge may not delete rows of a list: they come back unless the mode is a sweep, which drops none that pass
    judged_ = window.filter(F.col("_reranked") & ~sweep).select("query_id").distinct()
    back = candidates_.join(guaranteed.select("query_id", key).distinct(), ["query_id", key], "left_semi").join(judged_, "query_id", "left_semi").join(out.select("query_id", key), ["query_id", key], "left_anti")
    both = back.select("query_id", key, F.lit(0).alias("_k"), F.col("position").alias("_p")).unionByName(out.select("query_id", key, F.lit(1).alias("_k"), F.col("rank").alias("_p")))
    return both.select("query_id", key, F.row_number().over(per.orderBy("_k", "_p", key)).alias("rank"))


def put_first(guaranteed: DataFrame, candidates_: DataFrame, key: str) -> DataFrame:
    """Guaranteed rows (query_id, key) ahead of the candidates (query_id, key, position), each key once."""
    both = guaranteed.select("query_id", key, F.lit(0).alias("_k"), F.lit(0).alias("position")).unionByName(candidates_.select("query_id", key, F.lit(1).alias("_k"), "position"))
    once = both.groupBy("query_id", key).agg(F.min(F.struct("_k", "position")).alias("_p"))
    return once.select("query_id", key, F.row_number().over(Window.partitionBy("query_id").orderBy("_p._k", "_p.position", key)).alias("position"))


def escalations(plans_: DataFrame, answers: DataFrame) -> DataFrame:
    """Plans of questions to ask once more as multi-hop: refused, by a plan that doesn't take questions apart.

    ``answers``: query_id, text. The rows come with the multi-hop profile.
    """
    refused = answers.filter(text.is_refusal(F.col("text"))).select("query_id")
    again = plans_.filter("NOT decompose").join(refused, "query_id", "left_semi").select("query_id", "text", F.lit("multi_hop").alias("intent"))
    return again.join(F.broadcast(profiles(plans_.sparkSession)), "intent")
