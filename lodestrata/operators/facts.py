"""Exact facts: tables as cells, resolving what a question names, and verdicts one can trust.

A lookup or an aggregate is ``confident`` only if exactly one row can be meant. Otherwise it is
``ambiguous`` or ``empty``, and no row is picked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.fuzzy import fuzzy_score, plain_ratio
from ..sources.shared import settled

# What looks like an identifier, and words that don't name anything.
ID_CODE = r"^[A-Za-z]{1,6}[-_]?\d{2,10}$"
FILLER = ["in", "on", "at", "of", "the", "a", "an", "for", "to", "is", "are", "and"]


def cells(table: DataFrame, table_id: str, entity: str, columns: dict[str, str], order: str, title: str = "", cap: int | None = 20000) -> DataFrame:
    """One row per filled cell: table_id, row_index, entity, entity_norm, column_name, column_norm, value.

    ``columns``: what a column is called in questions, by its name. ``cap`` bounds the cells of
    one extracted table (None: a relational table, all of it).
    """
    pairs = [F.struct(F.lit(n).alias("n"), F.lit(shown).alias("column_name"), F.col(c).cast("string").alias("value")) for n, (c, shown) in enumerate(columns.items())]
    long = table.select(F.lit(table_id).alias("table_id"), F.lit(title).alias("table_title"), F.col(order).alias("row_index"), F.col(entity).alias("entity"), F.explode(F.array(*pairs)).alias("c"))
    full = long.filter((text.strip(F.coalesce("c.value", F.lit(""))) != "") & (text.strip(F.coalesce("entity", F.lit(""))) != ""))
    if cap is not None:
        full = full.orderBy("row_index", "c.n").limit(cap)  # the best of each task, then of all: no window over the whole table
    return full.select("table_id", "table_title", "row_index", "entity", text.normalise_label(F.col("entity")).alias("entity_norm"), "c.column_name", text.normalise_label(F.col("c.column_name")).alias("column_norm"), "c.value")


def looks_like_ids(values: Column) -> Column:
    """Whether at least 3 of an array's first 50 filled values, and nine in ten, are short codes."""
    sample = F.slice(F.filter(values, lambda v: text.strip(F.coalesce(v, F.lit(""))) != ""), 1, 50)
    return (F.size(sample) >= 3) & (F.size(F.filter(sample, lambda v: text.strip(v).rlike(ID_CODE))) >= 0.9 * F.size(sample))


def alias_cells(rows: DataFrame) -> DataFrame:
    """Cells of extracted tables; where the first column holds ids and the second doesn't, under both labels.

    ``rows``: table_id, row_index, header (array), cells (array).
    """
    leading = rows.select("table_id", "row_index", F.posexplode(F.slice("cells", 1, 2)).alias("_c", "v")).filter(text.strip(F.coalesce("v", F.lit(""))) != "")
    # the first 50 filled values of either column, however many blank ones stand before them
    first = leading.withColumn("_r", F.row_number().over(Window.partitionBy("table_id", "_c").orderBy("row_index"))).filter("_r <= 50")
    values = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == c, F.struct("row_index", "v")))), lambda x: x["v"])
    widths = rows.groupBy("table_id").agg(F.max(F.size("header")).alias("_w"))
    shape = first.groupBy("table_id").agg(values(0).alias("_a"), values(1).alias("_b")).join(widths, "table_id")
    both = shape.select("table_id", ((F.col("_w") > 2) & looks_like_ids(F.col("_a")) & ~looks_like_ids(F.col("_b"))).alias("_alias"))
    labelled = rows.join(both, "table_id", "left").select("table_id", "row_index", "header", "cells", F.explode(F.when(F.coalesce("_alias", F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_e"))
    long = labelled.select("table_id", "row_index", F.get("cells", F.col("_e")).alias("entity"), "_e", F.posexplode(F.arrays_zip("header", "cells")).alias("_c", "x"))
    full = long.filter((F.col("_c") != F.col("_e")) & (text.strip(F.coalesce("x.cells", F.lit(""))) != "") & (text.strip(F.coalesce("entity", F.lit(""))) != ""))
    name = F.coalesce(F.nullif(text.strip(F.col("x.header")), F.lit("")), F.concat(F.lit("col"), (F.col("_c") + 1).cast("string")))
    return full.select("table_id", "row_index", "entity", text.normalise_label(F.col("entity")).alias("entity_norm"), name.alias("column_name"), text.normalise_label(name).alias("column_norm"), F.col("x.cells").alias("value"))


def vocabulary(all_cells: DataFrame) -> DataFrame:
    """kind (column or entity), norm, display (of the first row) and the tables that have it."""
    one = lambda kind, norm, shown: all_cells.select(F.lit(kind).alias("kind"), F.col(norm).alias("norm"), F.col(shown).alias("display"), "table_id", "row_index")
    both = one("column", "column_norm", "column_name").union(one("entity", "entity_norm", "entity"))
    return both.groupBy("kind", "norm").agg(F.min_by("display", F.struct("table_id", "row_index", "display")).alias("display"), F.array_sort(F.collect_set("table_id")).alias("table_ids"))


def spans(questions: DataFrame, longest: int = 4) -> DataFrame:
    """query_id, span, start, end (exclusive): every run of 1 to ``longest`` label tokens."""
    tokens = F.filter(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(text.LABEL_TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, "'s$|'$", "")), lambda t: t != "")
    q = questions.select("query_id", tokens.alias("_t"))
    sized = q.select("query_id", "_t", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).filter(F.size("_t") >= F.col("n"))
    placed = sized.select("query_id", "_t", "n", F.explode(F.sequence(F.lit(0), F.size("_t") - F.col("n"))).alias("start"))
    return placed.select("query_id", F.array_join(F.slice("_t", F.col("start") + 1, F.col("n")), " ").alias("span"), "start", (F.col("start") + F.col("n")).alias("end"))


def variants(spans_: DataFrame) -> DataFrame:
    """Each span with its synonym forms; ``variant_no`` 0 is the span itself."""
    forms = [F.array(F.col("span"))]
    for word, others in text.SYNONYMS.items():
        whole = F.concat(F.lit(" "), "span", F.lit(" ")).contains(f" {word} ")
        swapped = F.array(*[F.replace(F.col("span"), F.lit(word), F.lit(o)) for o in others])
        forms.append(F.when(F.col("span") == word, F.array(*[F.lit(o) for o in others])).when(whole, swapped).otherwise(F.array().cast("array<string>")))
    return spans_.select("*", F.posexplode(F.array_distinct(F.concat(*forms))).alias("variant_no", "variant"))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}start") < F.col(f"{b}end")) & (F.col(f"{b}start") < F.col(f"{a}end"))


def digit_runs(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0))


def resolve_exact(variants_: DataFrame, choices: DataFrame) -> DataFrame:
    """The longest, leftmost span of each question that equals an entry: query_id, span, start, end, norm, display, score."""
    hits = variants_.join(choices.select(F.col("norm"), "display", "table_ids"), F.col("variant") == F.col("norm"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.col("end") - F.col("start")), "start", "variant_no")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "span", "start", "end", "norm", "display", "table_ids", F.lit(100.0).alias("score"))


def fuzzy_candidates(variants_: DataFrame, choices: DataFrame) -> DataFrame:
    """Pairs that may be compared: equal digit runs (the join key), and a real word in common or nearly so.

    The distinct words of the questions are held against the distinct words of the entries, each
    pair once; spans and entries then meet by digit runs and words that are 60 alike or more.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"\d+", " "), r"\s+"), lambda w: w != "")
    real = lambda c: F.filter(words(c), lambda w: (F.length(w) >= 3) & ~w.isin(FILLER))
    left = variants_.filter(~F.col("variant").rlike(r"^\s*\d+\s*$")).withColumn("_d", F.array_join(digit_runs(F.col("variant")), "|")).withColumn("_w", F.explode(real(F.col("variant"))))
    right = choices.select("norm", "display", "table_ids").withColumn("_d", F.array_join(digit_runs(F.col("norm")), "|")).withColumn("_c", F.explode(F.array_distinct(words(F.col("norm")))))
    asked, named = left.select("_w", F.length("_w").alias("_a")).distinct(), right.select("_c", F.length("_c").alias("_b")).distinct()
    # 60 alike: the common subsequence is 0.3 of both lengths together, and no longer than the shorter word
    able = asked.withColumn("_b", F.explode(F.sequence(F.ceil(F.col("_a") * 3 / 7).cast("int"), F.floor(F.col("_a") * 7 / 3).cast("int")))).join(named, "_b")
    near = able.filter((F.col("_w") == F.col("_c")) | (plain_ratio("_w", "_c") >= 60)).select("_w", "_c")
    return left.join(near, "_w").join(right, ["_d", "_c"]).select("query_id", "span", "start", "end", "variant", "variant_no", "norm", "display", "table_ids").distinct()


def resolve(variants_: DataFrame, choices: DataFrame) -> DataFrame:
    """Exact first, then the best fuzzy match; one row per question that names anything."""
    exact = settled(resolve_exact(variants_, choices))
    rest = variants_.join(exact.select("query_id"), "query_id", "left_anti")
    scored = fuzzy_candidates(rest, choices).withColumn("score", F.round(fuzzy_score("variant", "norm"), 4))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "norm")
    best = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "span", "start", "end", "norm", "display", "table_ids", "score")
    return exact.unionByName(best)


def resolve_extra_columns(variants_: DataFrame, columns: DataFrame, claimed: DataFrame) -> DataFrame:
    """Further columns that are named exactly by spans which don't overlap the claimed ones.

    Two such spans may overlap each other; the longer, then the left one counts, found among the
    few spans of one question by a fold.
    """
    taken = claimed.select("query_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("norm").alias("t_norm"))
    grouped = taken.groupBy("query_id").agg(F.collect_list(F.struct(F.col("t_start").alias("start"), F.col("t_end").alias("end"))).alias("_t"), F.collect_set("t_norm").alias("_seen"))
    hits = variants_.join(columns.select("norm", "display"), F.col("variant") == F.col("norm"))
    item = F.struct((F.col("start") - F.col("end")).alias("longest"), "start", "variant_no", "end", "norm", "display", "span")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_h")).join(grouped, "query_id", "left")
    start = F.struct(F.coalesce("_t", F.array().cast("array<struct<start:int,end:int>>")).alias("t"), F.coalesce("_seen", F.array().cast("array<string>")).alias("seen"), F.array().cast("array<struct<start:int,end:int,norm:string,display:string,span:string>>").alias("out"))

    def step(s, h):
        clash = F.exists(s["t"], lambda t: (t["start"] < h["end"]) & (h["start"] < t["end"])) | F.array_contains(s["seen"], h["norm"])
        row = F.struct(h["start"].alias("start"), h["end"].alias("end"), h["norm"].alias("norm"), h["display"].alias("display"), h["span"].alias("span"))
        return F.when(clash, s).otherwise(F.struct(F.array_append(s["t"], F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("t"), F.array_append(s["seen"], h["norm"]).alias("seen"), F.array_append(s["out"], row).alias("out")))

    return per.select("query_id", F.explode(F.aggregate("_h", start, step, lambda s: s["out"])).alias("x")).select("query_id", "x.*")


def aggregate_intent(q: DataFrame, trust: float = 85.0) -> DataFrame:
    """Adds kind (max, min, count, filter or ''), comparator and threshold.

    ``q``: text, column_span, column_norm, entity_score. A question that names a row is a lookup,
    and a superlative inside the column's own name is no superlative.
    """
    named = F.concat_ws(" ", "column_span", "column_norm")
    top, low = text.first_cue(F.col("text"), text.MAX_CUES), text.first_cue(F.col("text"), text.MIN_CUES)
    inside = lambda cue: F.concat(F.lit(" "), named, F.lit(" ")).contains(F.concat(F.lit(" "), cue, F.lit(" ")))
    above, below = text.first_cue(F.col("text"), text.ABOVE_CUES), text.first_cue(F.col("text"), text.BELOW_CUES)
    more, less = numbers.number_after(F.col("text"), above), numbers.number_after(F.col("text"), below)
    many = F.when(text.first_cue(F.col("text"), ["how many", "count"]) != "", "count").otherwise("filter")
    row_named = F.coalesce(F.col("entity_score") >= trust, F.lit(False))
    kind = F.when(row_named, "").when((top != "") & ~inside(top), "max").when((low != "") & ~inside(low), "min").when(more.isNotNull(), many).when(less.isNotNull(), many).otherwise("")
    out = q.withColumn("kind", kind)
    asks = F.col("kind").isin("count", "filter")
    return out.withColumn("comparator", F.when(asks, F.when(more.isNotNull(), ">").otherwise("<")).otherwise("")).withColumn("threshold", F.when(asks, F.coalesce(more, less)))


def lookup(probes: DataFrame, all_cells: DataFrame) -> DataFrame:
    """query_id, verdict, value, n_rows for probes (query_id, entity_norm, column_norm): confident only for one row."""
    by = ["entity_norm", "column_norm"]
    # cells of one name and column are counted before the probes meet them: a name that many rows share makes no pairs
    counted = all_cells.join(probes.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.count("value").alias("_n"), F.min("value").alias("_v"))
    hits = probes.join(counted, by, "left").groupBy("query_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.min("_v").alias("_v"))
    return hits.select("query_id", F.when(F.col("n_rows") == 1, "confident").when(F.col("n_rows") == 0, "empty").otherwise("ambiguous").alias("verdict"), F.when(F.col("n_rows") == 1, F.col("_v")).alias("value"), "n_rows")


def _column(all_cells: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(all_cells.withColumn("number", numbers.leading_number(F.col("value"))), "column_norm")


def extreme(probes: DataFrame, all_cells: DataFrame) -> DataFrame:
    """MAX and MIN with a single winner: query_id, verdict, entity, value, n_winners. A tie, or a column of several tables, is ambiguous.

    Probes: query_id, column_norm, kind. One pass keeps the best number, how many rows have it
    and one of them: three numbers a question, however long the column.
    """
    rows = _column(all_cells, probes).filter("number IS NOT NULL").withColumn("_key", F.when(F.col("kind") == "max", F.col("number")).otherwise(-F.col("number")))
    by_value = rows.groupBy("query_id", "_key").agg(F.count("*").alias("n"), F.min_by(F.struct("entity", "value", "table_id", "table_title"), F.struct("table_id", "row_index")).alias("w"), F.min("table_id").alias("_ta"), F.max("table_id").alias("_tb"))
    best = by_value.groupBy("query_id").agg(F.max_by(F.struct("n", "w"), "_key").alias("b"), F.min("_ta").alias("_ta"), F.max("_tb").alias("_tb"))
    single = (F.col("b.n") == 1) & (F.col("_ta") == F.col("_tb"))
    found = best.select("query_id", F.when(single, "confident").otherwise("ambiguous").alias("verdict"), F.when(single, F.col("b.w.entity")).alias("entity"), F.when(single, F.col("b.w.value")).alias("value"), F.when(single, F.col("b.w.table_title")).alias("table_title"), F.col("b.n").alias("n_winners"))
    none = probes.select("query_id").join(found, "query_id", "left")
    return none.select("query_id", F.coalesce("verdict", F.lit("empty")).alias("verdict"), "entity", "value", "table_title", F.coalesce("n_winners", F.lit(0)).alias("n_winners"))


def beyond(probes: DataFrame, all_cells: DataFrame, cap: int = 20) -> DataFrame:
    """Rows above or below a threshold: query_id, verdict, n_rows, entities (sorted; null beyond ``cap`` or for a count)."""
    hit = F.when(F.col("comparator") == ">", F.col("number") > F.col("threshold")).otherwise(F.col("number") < F.col("threshold"))
    rows = _column(all_cells, probes).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("query_id", "_hit").orderBy("entity", "row_index"))
    counted = rows.groupBy("query_id", "kind").agg(F.count_if("_hit").alias("n_rows"), F.min("table_id").alias("_ta"), F.max("table_id").alias("_tb"))
    # no more names are gathered than may be listed
    named = rows.filter((F.col("kind") == "filter") & F.col("_hit")).withColumn("_n", nth).filter(F.col("_n") <= cap).groupBy("query_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    both = counted.join(named, "query_id", "left")
    several = F.col("_ta") != F.col("_tb")
    too_many = (F.col("kind") == "filter") & (F.col("n_rows") > cap)
    verdict = F.when(several | too_many, "ambiguous").when((F.col("kind") == "filter") & (F.col("n_rows") == 0), "empty").otherwise("confident")
    return both.select("query_id", verdict.alias("verdict"), "n_rows", F.when(~too_many & ~several, F.col("entities")).alias("entities"))


def fires(q: DataFrame, fire: float = 78.0) -> Column:
    """Whether to look for a fact at all: a column and either an entity or a numeric cue."""
    cue = text.first_cue(F.col("text"), text.NUMERIC_CUES) != ""
    return F.coalesce(F.col("column_score") >= fire, F.lit(False)) & (F.coalesce(F.col("entity_score") >= fire, F.lit(False)) | cue)


def trusted(entity: Column, column: Column, question: Column, trust: float = 85.0) -> Column:
    """Both names are sure enough and the question doesn't ask for several answers."""
    return (entity >= trust) & (column >= trust) & (text.first_cue(question, text.MULTI_ANSWER_CUES) == "")


def render(fact: DataFrame, column_name: str) -> DataFrame:
    """Adds the line that states a fact and the place it is cited from."""
    line = F.when(F.col("verdict") == "confident", F.concat(F.lit("EXACT FACT: "), "entity", F.lit(" — "), F.lit(column_name), F.lit(": "), "value", F.lit(" (source: "), "table_title", F.lit(")")))
    return fact.withColumn("fact", line)


def ask(questions: DataFrame, all_cells: DataFrame, fire: float = 78.0, trust: float = 85.0, cap: int = 20) -> DataFrame:
    """From question to verdict for a batch: query_id, kind, verdict, entity, column, value, n_rows.

    Column first, then the entity from spans that don't overlap it and hold no comparing word. The
    vocabulary and what is resolved are written out once, as several branches read them.
    """
    words = settled(vocabulary(all_cells))
    every = settled(variants(spans(questions)))
    column = settled(resolve(every, words.filter("kind = 'column'")))
    reserved = text.MAX_CUES + text.MIN_CUES + text.ABOVE_CUES + text.BELOW_CUES
    held = reduce(lambda a, b: a | b, [F.concat(F.lit(" "), "span", F.lit(" ")).contains(f" {w} ") for w in reserved])
    at = column.select("query_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    free = every.join(at, "query_id").filter(~((F.col("start") < F.col("c_end")) & (F.col("c_start") < F.col("end"))) & ~held).drop("c_start", "c_end")
    entity = settled(resolve(free, words.filter("kind = 'entity'")))
    named = questions.join(column.select("query_id", F.col("span").alias("column_span"), F.col("norm").alias("column_norm"), F.col("score").alias("column_score")), "query_id", "left")
    named = named.join(entity.select("query_id", F.col("norm").alias("entity_norm"), F.col("score").alias("entity_score")), "query_id", "left")
    planned = settled(aggregate_intent(named, trust))
    live = planned.filter(fires(planned, fire))
    best = extreme(live.filter(F.col("kind").isin("max", "min")).select("query_id", "column_norm", "kind"), all_cells).select("query_id", "verdict", "entity", "value", F.col("n_winners").alias("n_rows"))
    many = beyond(live.filter(F.col("kind").isin("count", "filter")).select("query_id", "column_norm", "kind", "comparator", "threshold"), all_cells, cap).select("query_id", "verdict", F.array_join("entities", "; ").alias("entity"), F.col("n_rows").cast("string").alias("value"), "n_rows")
    one = live.filter((F.col("kind") == "") & trusted(F.col("entity_score"), F.col("column_score"), F.col("text"), trust))
    cell = lookup(one.select("query_id", "entity_norm", "column_norm"), all_cells).join(one.select("query_id", F.col("entity_norm").alias("entity")), "query_id").select("query_id", "verdict", "entity", "value", "n_rows")
    found = best.unionByName(many).unionByName(cell)
    out = planned.select("query_id", "kind", F.col("column_norm").alias("column")).join(found, "query_id", "left")
    return out.select("query_id", "kind", "column", F.coalesce("verdict", F.lit("skipped")).alias("verdict"), "entity", "value", "n_rows")
