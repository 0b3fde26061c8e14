"""Grounding: which claims of an answer its context doesn't support, and what may be cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# What counts as a figure or an identifier.
NUMERIC_CLAIM = r"\b\d[\d,.]*\b"
IDENT_CLAIM = r"\b[A-Z]{1,4}-\d{1,4}\b|\bAES-?\d{3}\b|\bTLS\s?\d\.\d\b"
LIST_MARK = r"(?m)^\s*(?:[-*+]\s+|#{1,6}\s+)?\d+[.)]\s+"


def numeric_claims(value: Column) -> Column:
    """Figures without commas and closing points, list numbers left out."""
    raw = F.regexp_extract_all(F.regexp_replace(value, LIST_MARK, ""), F.lit(NUMERIC_CLAIM), F.lit(0))
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"\.+$", "")), lambda x: x != ""))


def ident_claims(value: Column) -> Column:
    raw = F.regexp_extract_all(F.regexp_replace(value, LIST_MARK, ""), F.lit(IDENT_CLAIM), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit("")))))


def unsupported(answers: DataFrame, context: DataFrame, by: str) -> DataFrame:
    """by, claim of figures and identifiers that no context of the same key holds. ``answers`` and ``context``: by, text."""
    claims = lambda df: df.select(by, F.explode(F.concat(numeric_claims(F.col("text")), ident_claims(F.col("text")))).alias("claim")).distinct()
    return claims(answers).join(claims(context), [by, "claim"], "left_anti")


def rescued(claims: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """Claims that a cell of a quoted table or an exact fact supports after all."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"[\s,]", ""))
    return claims.withColumn("_c", norm(F.col("claim"))).join(values.select(by, norm(F.col("value")).alias("_c")).distinct(), [by, "_c"], "left_semi").drop("_c")


def units(answers: DataFrame, by: str) -> DataFrame:
    """by, unit_no, kind, unit: list, heading and table lines whole, prose by sentences."""
    lines = answers.select(by, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(text.strip(F.col("line")) != "")
    kind = F.when(F.col("line").rlike(r"^\s*\|"), "table").when(F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)]|#{1,6})\s"), "item").otherwise("prose")
    marked = lines.withColumn("kind", kind)
    parts = F.when(F.col("kind") == "prose", F.split("line", r"(?<=[.!?])\s+")).otherwise(F.array("line"))
    flat = marked.select(by, "line_no", "kind", F.posexplode(parts).alias("part_no", "unit"))
    return flat.withColumn("unit_no", F.row_number().over(Window.partitionBy(by).orderBy("line_no", "part_no"))).drop("line_no", "part_no")


def prune(answers: DataFrame, bad: DataFrame, by: str, overlap: float = 0.6) -> DataFrame:
    """by, text without the units that hold an unsupported claim, or mostly consist of its words.

    Table headers that are left without rows go too. ``bad``: by, claim.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9.,-]+"), lambda w: w != ""))
    listed = bad.groupBy(by).agg(F.collect_set("claim").alias("_bad"))
    held = units(answers, by).join(listed, by, "left")
    flat = F.replace(F.col("unit"), F.lit(","), F.lit(""))
    hit = F.exists("_bad", lambda c: flat.contains(c) | ((F.size(words(c)) > 1) & (F.size(F.array_intersect(words(F.col("unit")), words(c))) >= overlap * F.size(words(c)))))
    kept = held.filter(~F.coalesce(hit, F.lit(False))).drop("_bad")
    w = Window.partitionBy(by).orderBy("unit_no")
    rule = F.col("unit").rlike(r"^\s*\|[\s:|-]+\|\s*$")
    island = kept.withColumn("_rule", rule).withColumn("_next", F.lead("kind").over(w)).withColumn("_after", F.lead(rule).over(w)).withColumn("_second", F.lead("kind", 2).over(w))
    alone = (F.col("_rule") & F.coalesce(F.col("_next") != "table", F.lit(True))) | (F.coalesce(F.col("_after"), F.lit(False)) & F.coalesce(F.col("_second") != "table", F.lit(True)) & (F.col("kind") == "table"))
    good = island.filter(~alone)
    return good.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit"))), lambda x: x["unit"]), "\n").alias("text"))


def content_words(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def contributing(units_: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Units that share a content word with the answer; all of them if the answer is empty."""
    asked = answers.select(by, content_words(F.col("text")).alias("_a"), (text.strip(F.col("text")) == "").alias("_none"))
    return units_.join(asked, by).filter(F.col("_none") | F.arrays_overlap(content_words(F.col("text")), "_a")).drop("_a", "_none")


def citations(units_: DataFrame, by: str, order: str) -> DataFrame:
    """Each place (source, page, section) once, in order of first use, with a snippet."""
    w = Window.partitionBy(by, "source", "page", "section").orderBy(order)
    first = units_.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("citation_no"), "source", "page", "section", text.snippet(F.col("text")).alias("snippet"))


# ---------------------------------------------------------------- verdict and repair

# What an answer says when the documents don't hold all of it.
INCOMPLETE = r"(?i)\b(do(?:es)?\s+not\s+(?:cover|specify|state|mention|provide|include)|not\s+specified|no\s+information\s+(?:about|on)|documents?\s+do\s+not)\b"


def says_incomplete(answer: Column) -> Column:
    return answer.rlike(INCOMPLETE)


def verdicts(answers: DataFrame, context: DataFrame, by: str, judged: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """by, faithful, unverified (figures that the context lacks), unsupported (claims), note, one row per answer.

    ``judged``: by, claims (array of what a judge finds unsupported; no row: not judged). A claim
    that stands in a cell of ``cells`` (by, value) is supported after all. Without a judgement the
    figures decide.
    """
    missing = unsupported(answers, context, by).groupBy(by).agg(F.array_sort(F.collect_set("claim")).alias("unverified"))
    out = answers.select(by).distinct().join(missing, by, "left").withColumn("unverified", F.coalesce("unverified", F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    if judged is None:
        return out.select(by, (F.size("unverified") == 0).alias("faithful"), "unverified", none.alias("unsupported"), F.lit("structural check only").alias("note"))
    claims = judged.select(by, F.posexplode_outer("claims").alias("_k", "claim"))
    if cells is not None:
        saved = rescued(claims.select(by, "claim").filter("claim IS NOT NULL").distinct(), cells, by).withColumn("_saved", F.lit(True))
        claims = claims.join(saved, [by, "claim"], "left")
    else:
        claims = claims.withColumn("_saved", F.lit(None).cast("boolean"))
    left = F.when(F.col("claim").isNotNull() & F.col("_saved").isNull(), F.struct("_k", "claim"))
    per = claims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(left)), lambda x: x["claim"]).alias("unsupported"), F.count_if("_saved").alias("_dropped"))
    both = out.join(per, by, "left")
    judged_ = F.col("unsupported").isNotNull()
    note = F.when(~judged_, "no judgement; structural check only").when(F.col("_dropped") > 0, "dropped claims that a table cell states").otherwise("")
    return both.select(by, F.when(judged_, F.size("unsupported") == 0).otherwise(F.size("unverified") == 0).alias("faithful"), "unverified", F.coalesce("unsupported", none).alias("unsupported"), note.alias("note"))


def repair_is_safe(answers: DataFrame, repaired: DataFrame, context: DataFrame, by: str) -> DataFrame:
    """by, safe: whether a repaired answer keeps every figure of the first one that the context supports.

    A figure is supported by the same whole figure: 20 is not by 2024.
    """
    claims = lambda df: df.select(by, F.explode(F.concat(numeric_claims(F.col("text")), ident_claims(F.col("text")))).alias("claim")).distinct()
    supported = claims(answers).join(claims(context), [by, "claim"], "left_semi")
    lost = supported.join(claims(repaired), [by, "claim"], "left_anti").select(by).distinct().withColumn("_lost", F.lit(True))
    return repaired.select(by).distinct().join(lost, by, "left").select(by, F.col("_lost").isNull().alias("safe"))


def without_refusal(answers: DataFrame, by: str) -> DataFrame:
    """by, text without units that are the refusal, where others stand beside them; by, text, refused (nothing else is left)."""
    parts = units(answers, by).withColumn("_no", text.is_refusal(F.col("unit")))
    listed = F.array_sort(F.collect_list(F.when(~F.col("_no"), F.struct("unit_no", "unit"))))
    per = parts.groupBy(by).agg(F.count_if("_no").alias("_nos"), F.array_join(F.transform(listed, lambda x: x["unit"]), "\n").alias("_rest"))
    both = answers.join(per, by, "left")
    said = F.when(F.coalesce("_nos", F.lit(0)) == 0, F.col("text")).otherwise(F.col("_rest"))
    return both.select(by, said.alias("text"), (text.strip(said) == "").alias("refused"))


def fenced(answer: Column, unsupported_: Column) -> Column:
    """The answer with a note that names what the documents don't confirm."""
    # Fixed value: the wording of the note.
    note = F.concat(F.lit("\n\n[Unverified -- not confirmed by the documents: "), F.array_join(unsupported_, "; "), F.lit("]"))
    return F.when(F.size(unsupported_) > 0, F.concat(text.strip(answer), note)).otherwise(answer)


def enforce(answers: DataFrame, context: DataFrame, verdicts_: DataFrame, by: str, refusal: str, repaired: DataFrame | None = None, rejudged: DataFrame | None = None) -> DataFrame:
    """by, text, action, faithful: what may be said. Only answers with claims worth a repair change.

    Claims that say what the documents lack are no claims about the world: an answer with none
    besides stays. A ``repaired`` answer (by, text) is taken if it keeps all supported figures and
    passes a second look: ``rejudged`` (by, claims), or else its figures. One that is the refusal
    withdraws the answer. Otherwise the units of the first answer that hold the claims, those found
    in the repaired one too, are pruned: if nothing is left the answer is withdrawn, if that loses
    a supported figure it stays with a note. ``faithful``: no unsupported figure is left.
    """
    worth = F.filter("unsupported", lambda c: ~says_incomplete(c))
    bad = verdicts_.filter(~F.col("faithful")).select(by, worth.alias("unsupported")).filter(F.size("unsupported") > 0)
    wrong = answers.join(bad.select(by), by, "left_semi")
    claims = bad.select(by, F.explode("unsupported").alias("claim"))
    if repaired is not None:
        again = without_refusal(repaired.join(bad.select(by), by, "left_semi").select(by, "text"), by)
        rest = again.filter("NOT refused")
        found = rejudged.select(by, F.explode("claims").alias("claim")).filter(~says_incomplete(F.col("claim"))) if rejudged is not None else unsupported(rest.select(by, "text"), context, by)
        found = found.join(rest.select(by), by, "left_semi")
        safe = repair_is_safe(wrong, rest, context, by).filter("safe").select(by)
        mended = rest.join(safe, by, "left_semi").join(found.select(by), by, "left_anti").select(by, F.col("text").alias("_repaired"))
        gone = again.filter("refused").select(by, F.lit(True).alias("_gone"))
        claims = claims.unionByName(found.join(safe, by, "left_semi")).distinct()
    else:
        mended = answers.limit(0).select(by, F.col("text").alias("_repaired"))
        gone = answers.limit(0).select(by, F.lit(True).alias("_gone"))
    pruned = prune(wrong, claims, by).select(by, F.col("text").alias("_pruned"))
    cut = wrong.select(by).join(pruned, by, "left").select(by, F.coalesce("_pruned", F.lit("")).alias("text"))
    keeps = repair_is_safe(wrong, cut, context, by).select(by, F.col("safe").alias("_cut_safe"))
    out = answers.select(by, "text").join(bad, by, "left").join(pruned, by, "left").join(keeps, by, "left").join(mended, by, "left").join(gone, by, "left")
    nothing = text.strip(F.coalesce("_pruned", F.lit(""))) == ""
    action = (
        F.when(F.col("unsupported").isNull(), "kept").when(F.col("_gone"), "refused").when(F.col("_repaired").isNotNull(), "repaired")
        .when(nothing, "refused").when(F.col("_cut_safe"), "pruned").otherwise("fenced")
    )
    said = (
        F.when(F.col("action") == "kept", F.col("text")).when(F.col("action") == "refused", F.lit(refusal)).when(F.col("action") == "repaired", F.col("_repaired"))
        .when(F.col("action") == "pruned", F.col("_pruned")).otherwise(fenced(F.col("text"), F.col("unsupported")))
    )
    final = out.withColumn("action", action).select(by, said.alias("text"), "action")
    residual = unsupported(final.filter("action <> 'refused'"), context, by).select(by).distinct().withColumn("_left", F.lit(True))
    return final.join(residual, by, "left").select(by, "text", "action", F.col("_left").isNull().alias("faithful"))


def with_fact_sources(citations_: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Citations, and one more for every fact whose place (source, page, section) isn't cited yet.

    ``facts``: by, source, page, table_title, entity, column, value.
    """
    place = [by, "source", "page", "section"]
    snippet = F.concat(F.col("entity"), F.lit(" - "), F.col("column"), F.lit(": "), F.col("value"))
    new = facts.select(by, "source", "page", F.col("table_title").alias("section"), snippet.alias("snippet")).join(citations_.select(*place), place, "left_anti")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("snippet"))).filter("_n = 1").drop("_n")
    count = citations_.groupBy(by).agg(F.max("citation_no").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("source", "page", "section")) + F.coalesce("_last", F.lit(0))
    added = first.join(count, by, "left").withColumn("citation_no", nth).drop("_last")
    return citations_.unionByName(added, allowMissingColumns=True)


def merged_candidates(found: DataFrame, by: str, least: int = 2, most: int = 10) -> DataFrame:
    """by, position, item: what passages name, each once in any case, in order of first mention.

    ``found``: by, unit_no, items (array). Nothing comes of fewer than ``least`` or more than ``most`` passages.
    """
    sizes = found.groupBy(by).agg(F.countDistinct("unit_no").alias("_n")).filter(F.col("_n").between(least, most)).select(by)
    rows = found.join(sizes, by, "left_semi").select(by, "unit_no", F.posexplode("items").alias("_k", "item"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, F.lower("item")).orderBy("unit_no", "_k"))).filter("_n = 1")
    return first.select(by, F.row_number().over(Window.partitionBy(by).orderBy("unit_no", "_k")).alias("position"), "item")
