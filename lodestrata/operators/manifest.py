"""The manifest: what a document enumerates, and whether an answer covers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import rank

# What opens a list item, a labelled item, an enumeration, a section reference. The
# last stands in two parts, tried in turn, as an extraction gives one group only.
LIST_LEAD = r"(?i)^\s*(?:[-•*+]|\(?\d{1,2}[.)]|\(?[a-z][.)])\s+(\S.{2,120}?)\s*$"
LABELLED = r"^([^:–-]{2,60})\s*[:–-]\s+\S"
ENUMERATION = r"(?i)\b(all|every|each|list|enumerate|complete list|full list|types? of|kinds? of|what are the|which are the|how many)\b"
SECTION_REFERENCE = r"(?i)\b(?:the\s+)?([\w][\w '\-/&]{2,60}?)\s+section\b"
SECTION_CALLED = r"(?i)\bsection\s+(?:on\s+|about\s+|called\s+)?([\w][\w '\-/&]{2,60})"
COVER_FILLER = ["and", "or", "of", "the", "a", "an", "for", "to", "in", "by"]


def list_items(lines: DataFrame, key: str, order: str, line: str = "line", most: int = 12) -> DataFrame:
    """key, item_no, item of lines that look like list items, up to ``most`` of a chunk, repeats left out."""
    # a chunk's first line that is its breadcrumb, with a blank line after it, is no item
    after = F.lead(line).over(Window.partitionBy(key).orderBy(order))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    lines = lines.withColumn("_crumb", (place == 1) & F.col(line).contains(" > ") & F.coalesce(text.strip(after) == "", F.lit(False))).filter("NOT _crumb").drop("_crumb")
    body = F.regexp_extract(line, LIST_LEAD, 1)
    label = F.regexp_extract(body, LABELLED, 1)
    item = text.squeeze(F.when(label != "", label).otherwise(body))
    found = lines.withColumn("item", item).filter((F.col("item") != "") & (F.size(F.split("item", " ")) <= 10))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower("item")).orderBy(order))).filter("_n = 1")
    return first.withColumn("item_no", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("item_no") <= most).select(key, "item_no", "item")


def heading_tree(headings: DataFrame, by: str, path: str, page: str, order: str) -> DataFrame:
    """Each heading path once: level, page span, number of chunks, and its place in order of first sight."""
    tree = headings.groupBy(by, path).agg(F.min(order).alias("first_seen"), F.min(page).alias("page"), F.max(page).alias("page_end"), F.count("*").alias("n_chunks"))
    tree = tree.withColumn("level", F.size(F.split(path, " > ")))
    return tree.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("first_seen", path))).drop("first_seen")


def frequent_labels(labels: DataFrame, by: str, label: str, most: int = 40) -> DataFrame:
    counts = labels.groupBy(by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), label))).filter(F.col("rank") <= most)


def enumeration_terms(question: Column, most: int = 8) -> Column:
    """Content words of a question as terms: pairs first, then single words, at most ``most``."""
    words = F.filter(F.regexp_extract_all(question, F.lit(r"[A-Za-z][\w-]{2,}|\b[A-Z]{2}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(text.ENUMERATION_STOP))

    def terms(singles: Column) -> Column:
        pairs = F.filter(F.transform(singles, lambda w, i: F.concat(w, F.lit(" "), F.get(singles, i + 1))), lambda p: p.isNotNull())
        return F.slice(F.filter(F.array_distinct(F.concat(pairs, singles)), lambda t: F.length(t) >= 3), 1, most)

    return text.let(F.transform(words, text.singular), terms)


def head_noun(question: Column) -> Column:
    """The first content word; after "types of" or "kinds of" the last one."""
    words = lambda q: F.transform(F.filter(F.regexp_extract_all(q, F.lit(r"[A-Za-z][\w-]{2,}|\b[A-Z]{2}\b"), F.lit(0)), lambda w: ~F.lower(w).isin(text.ENUMERATION_STOP)), text.singular)
    tail = words(F.regexp_extract(question, r"(?i)\b(?:types?|kinds?)\s+of\b(.*)$", 1))
    return F.when(F.size(tail) > 0, F.get(tail, F.size(tail) - 1)).otherwise(F.coalesce(F.get(words(question), F.lit(0)), F.lit("")))


def enumeration_plan(terms: DataFrame, items: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """The group of items that answers each question best: query_id, group_label, items, n_items, truncated_from.

    ``terms``: query_id, term; ``items``: group_label, item, ordinal. A group that the term names
    counts whole; otherwise only its matching items do. Fewer than ``least`` items are no plan.
    Items meet terms by their first word, so no question is held against all items.
    """
    stem = lambda c: F.explode(F.array_distinct(F.transform(F.split(text.normalise_item(c), " "), text.singular)))
    asked = terms.select("query_id", "term", F.size(F.split("term", " ")).alias("words"), text.singular(F.get(F.split("term", " "), F.lit(0))).alias("_s"))
    groups = items.groupBy("group_label").agg(F.count("*").alias("size"))
    named = asked.join(groups.withColumn("_s", stem(F.col("group_label"))), "_s").filter(text.word_match(F.col("term"), F.col("group_label"))).select("query_id", "term", "words", "group_label", "size").distinct()
    single = asked.join(items.withColumn("_s", stem(F.col("item"))), "_s").filter(text.word_match(F.col("term"), F.col("item"))).select("query_id", "term", "words", "group_label", "item").distinct()
    counted = single.groupBy("query_id", "term", "words", "group_label").agg(F.count("*").alias("matched")).join(groups, "group_label")
    scored = named.select("query_id", "term", "words", "group_label", "size", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("matched")).unionByName(counted.select("query_id", "term", "words", "group_label", "size", F.lit(False).alias("whole"), "matched"))
    both = scored.groupBy("query_id", "term", "words", "group_label", "size").agg(F.max("whole").alias("whole"), F.max("matched").alias("matched"))
    score = F.round(2 * F.col("whole").cast("int") + F.col("matched") / F.col("size") + 0.25 * F.col("words"), 6)
    n = F.when(F.col("whole"), F.col("size")).otherwise(F.col("matched"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "group_label", "term")
    best = both.withColumn("score", score).withColumn("n_items", n).filter(F.col("n_items") >= least).withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return best.select("query_id", "term", "group_label", "whole", "score", F.least("n_items", F.lit(most)).cast("long").alias("n_items"), F.when(F.col("n_items") > most, F.col("n_items")).otherwise(0).cast("long").alias("truncated_from"))


# Fixed value: an overview's own heading isn't one of its members.
TYPES_OF = r"(?i)\b(?:types?|kinds?)\s+of\b"


def union_plan(terms: DataFrame, items: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """The members of one enumeration that stand in different groups of one document: query_id, term, document_id, score, items, n_items, truncated_from.

    ``terms``: query_id, term; ``items``: document_id, item. A term's items are those that it names,
    in the document that has the most of them, without overview headings, elaborations of another
    item and repeats; ``least`` of them must be left. Each question gets its best term, by half a
    point an item and a quarter a word of the term.
    """
    stem = lambda c: F.explode(F.array_distinct(F.transform(F.split(text.normalise_item(c), " "), text.singular)))
    asked = terms.select("query_id", "term", F.size(F.split("term", " ")).alias("words"), text.singular(F.get(F.split("term", " "), F.lit(0))).alias("_s"))
    members = items.select("document_id", "item").filter(~F.col("item").rlike(TYPES_OF))
    hits = asked.join(members.withColumn("_s", stem(F.col("item"))), "_s").filter(text.word_match(F.col("term"), F.col("item"))).drop("_s")
    per = hits.groupBy("query_id", "term", "document_id").agg(F.count("*").alias("_n"))
    fullest = rank.top(per, ["query_id", "term"], [F.desc("_n"), "document_id"], 1, "_k").select("query_id", "term", "document_id")
    own = hits.join(fullest, ["query_id", "term", "document_id"], "left_semi")
    short = without_elaborations(own, ["query_id", "term", "words", "document_id"])
    nth = Window.partitionBy("query_id", "term").orderBy("item")
    kept = short.withColumn("_nth", F.row_number().over(nth))
    listed = F.array_sort(F.collect_list(F.when(F.col("_nth") <= most, F.col("item"))))
    plans = kept.groupBy("query_id", "term", "words", "document_id").agg(F.count("*").alias("n"), listed.alias("items")).filter(F.col("n") >= least)
    scored = plans.withColumn("score", F.round(0.5 * F.col("n") + 0.25 * F.col("words"), 6))
    best = rank.top(scored, ["query_id"], [F.desc("score"), "term"], 1, "_k")
    return best.select("query_id", "term", "document_id", "score", "items", F.least("n", F.lit(most)).cast("long").alias("n_items"), F.when(F.col("n") > most, F.col("n")).otherwise(0).cast("long").alias("truncated_from"))


def best_plan(terms: DataFrame, items: DataFrame, least: int = 2, most: int = 25) -> DataFrame:
    """query_id, kind (group or union), term, label, score, n_items: a union of groups only where it scores above every single group.

    ``items``: document_id, group_label, item.
    """
    one = enumeration_plan(terms, items, least, most).select("query_id", F.lit("group").alias("kind"), "term", F.col("group_label").alias("label"), "score", "n_items")
    many = union_plan(terms, items, least, most).select("query_id", F.lit("union").alias("kind"), "term", F.col("document_id").cast("string").alias("label"), "score", "n_items")
    return rank.top(one.unionByName(many), ["query_id"], [F.desc("score"), "kind"], 1, "_k").drop("_k")


def section_name(question: Column) -> Column:
    """The section that a question names, without question words before it, or the empty text."""
    raw = F.coalesce(F.nullif(F.regexp_extract(question, SECTION_REFERENCE, 1), F.lit("")), F.regexp_extract(question, SECTION_CALLED, 1))
    words = F.filter(F.split(text.strip(raw), r"\s+"), lambda w: ~F.lower(w).isin(text.ENUMERATION_STOP) & (w != ""))
    name = F.array_join(words, " ")
    return F.when(F.length(name) >= 3, name).otherwise(F.lit(""))


def heading_filter(questions: DataFrame, paths: DataFrame, share: float = 0.5) -> DataFrame:
    """query_id, heading_path of sections that a question names; none if that keeps most of them."""
    total = paths.select(F.col("heading_path")).distinct().withColumn("_one", F.lit(1))
    size = total.groupBy("_one").agg(F.count("*").alias("_n"))
    leaf = F.get(F.reverse(F.split("heading_path", ">")), F.lit(0))
    stems = total.withColumn("_s", F.explode(F.array_distinct(F.transform(F.split(text.normalise_item(leaf), " "), text.singular))))
    asked = questions.withColumn("name", section_name(F.col("text"))).filter("name <> ''").withColumn("_s", text.singular(F.get(F.split(text.normalise_item(F.col("name")), " "), F.lit(0))))
    hits = asked.join(stems, "_s").filter(text.word_match(F.col("name"), leaf)).select("query_id", "heading_path", "_one").distinct()
    counted = hits.withColumn("_m", F.count("*").over(Window.partitionBy("query_id"))).join(size, "_one")
    return counted.filter(F.col("_m") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select("query_id", "heading_path")


def covers(label: Column, answer: Column) -> Column:
    """Whether an answer mentions a label: whole, or every word of it that matters as a word."""
    needle, hay = text.normalise_item(label), text.normalise_item(answer)
    words = F.filter(F.split(needle, " "), lambda w: ~w.isin(COVER_FILLER) & (w != ""))
    each = F.forall(words, lambda w: F.regexp_like(hay, F.concat(F.lit(r"\b"), F.regexp_replace(w, r"([^A-Za-z0-9_ ])", r"\\$1"), F.lit(r"\b"))))
    return (needle == "") | hay.contains(needle) | ((F.size(words) > 0) & each)


def missing_items(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, item of expected items (query_id, item) that the answer (query_id, answer) doesn't mention."""
    return expected.join(answers, "query_id").filter(~covers(F.col("item"), F.col("answer"))).select("query_id", "item")


def build(headings: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """A document's manifest: document_id, kind, group_label, group_context, item, heading_path, page, chunk_index, table_id.

    ``headings``: document_id, heading_path, page, chunk_index; ``rows``: document_id, source,
    table_id, section, header, row_index, page, cells; ``items``: document_id, heading_path, page,
    chunk_index, item. Of entries that agree in kind, group and normalised item the first counts.
    """
    none = lambda kind: F.lit(None).cast(kind)
    leaf = text.strip(F.element_at(F.split("heading_path", ">"), -1))
    above = F.array_join(F.slice(F.split("heading_path", " > "), F.lit(1), F.greatest(F.size(F.split("heading_path", " > ")) - 1, F.lit(0))), " > ")
    sections = headings.filter("heading_path <> ''").select("document_id", F.lit("section").alias("kind"), above.alias("group_label"), F.lit("").alias("group_context"), leaf.alias("item"), "heading_path", "page", "chunk_index", F.lit("").alias("table_id"), F.col("chunk_index").cast("long").alias("_o"))
    label = text.strip(F.translate(F.coalesce(F.get("cells", F.lit(0)), F.lit("")), "\n", " "))
    context = F.array_join(F.filter("header", lambda c: F.coalesce(c, F.lit("")) != ""), " | ")
    tables = rows.withColumn("_item", label).filter("_item <> ''").select("document_id", F.lit("table_row").alias("kind"), F.coalesce(F.nullif("section", F.lit("")), "source").alias("group_label"), context.alias("group_context"), F.col("_item").alias("item"), F.lit("").alias("heading_path"), "page", none("int").alias("chunk_index"), "table_id", F.col("row_index").cast("long").alias("_o"))
    listed = items.select("document_id", F.lit("list_item").alias("kind"), F.col("heading_path").alias("group_label"), F.lit("").alias("group_context"), "item", "heading_path", "page", "chunk_index", F.lit("").alias("table_id"), F.col("chunk_index").cast("long").alias("_o"))
    every = sections.unionByName(tables).unionByName(listed)
    first = Window.partitionBy("document_id", "kind", "group_label", text.normalise_item(F.col("item"))).orderBy("_o", "page", "item")
    return every.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_o")


def find_items(items: DataFrame, asked: DataFrame, kinds: list[str] | None = None, most: int = 300) -> DataFrame:
    """Items whose text, group or context holds a term of the question (query_id, term), in any case; ``most`` of a question.

    Terms are a stated set, checked to be small, that every task holds against its items.
    """
    n = asked.count()
    if n > 100_000:
        raise ValueError(f"{n} terms are too many to send out at once; ask in parts")
    rows = items if kinds is None else items.filter(F.col("kind").isin(kinds))
    hay = rows.withColumn("_hay", F.lower(F.concat_ws("\n", "item", "group_label", "group_context")))
    pairs = hay.join(F.broadcast(asked.select("query_id", F.lower("term").alias("_t"))), F.expr("contains(_hay, _t)"))
    hits = pairs.select("query_id", *items.columns).distinct()
    place = Window.partitionBy("query_id").orderBy("document_id", "group_label", F.col("page").asc_nulls_last(), "item")
    return hits.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most).drop("_n")


def group_items(items: DataFrame, groups: DataFrame) -> DataFrame:
    """All items of the asked groups (query_id, document_id, group_label), numbered in order of page and text."""
    own = items.join(groups, ["document_id", "group_label"])
    return own.withColumn("position", F.row_number().over(Window.partitionBy("query_id", "group_label").orderBy(F.col("page").asc_nulls_last(), "item")))


def without_elaborations(items: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """Of items that share what stands before a dash the shortest, then of equal ones the first."""
    prefix = text.normalise_item(F.get(F.split(item, r"\s*[-–]\s*"), F.lit(0)))
    short = items.withColumn("_p", prefix).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(F.length(item), item))).filter("_n = 1")
    same = Window.partitionBy(*by, text.normalise_item(F.col(item))).orderBy(item)
    return short.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n", "_p")


def targets(plan_items: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id, key of the chunks that hold the items of a plan: by table, else by place, else by heading.

    ``plan_items``: query_id, document_id, table_id, chunk_index, heading_path. Summaries of tables
    are no targets. Places are those of the item's own document.
    """
    body = chunks.filter(~F.coalesce("is_table_summary", F.lit(False)))
    table, place = F.coalesce("table_id", F.lit("")) != "", F.col("chunk_index").isNotNull()
    by_table = plan_items.filter(table).select("query_id", "document_id", "table_id").distinct().join(body, ["document_id", "table_id"])
    by_place = plan_items.filter(~table & place).select("query_id", "document_id", "chunk_index").distinct().join(body, ["document_id", "chunk_index"])
    by_path = plan_items.filter(~table & ~place & (F.coalesce("heading_path", F.lit("")) != "")).select("query_id", "document_id", "heading_path").distinct().join(body, ["document_id", "heading_path"])
    pick = lambda df: df.select("query_id", key)
    return pick(by_table).union(pick(by_place)).union(pick(by_path)).distinct()
