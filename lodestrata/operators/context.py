"""Assembling what an answer is based on: expansion, deduplication, merging, budgets, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import forget, settled


def neighbour_expand(hits: DataFrame, chunks: DataFrame, key: str, discount: float = 0.75) -> DataFrame:
    """Chunks before and after each hit that aren't hits, at a discount on the best origin's score.

    ``hits``: query_id, key, score; ``chunks``: key, prev_id, next_id.
    """
    near = hits.join(chunks.select(key, "prev_id", "next_id"), key)
    out = near.select("query_id", F.col(key).alias("expanded_from"), "score", F.explode(F.array("prev_id", "next_id")).alias("_to")).filter("_to IS NOT NULL")
    best = out.groupBy("query_id", F.col("_to").alias(key)).agg(F.max_by("expanded_from", F.struct("score", -F.col("expanded_from"))).alias("expanded_from"), F.round(discount * F.max("score"), 9).alias("score"))
    return best.join(hits.select("query_id", key), ["query_id", key], "left_anti")


def to_parents(hits: DataFrame, children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Each hit's parent in its place, each parent once; hits without one stay themselves."""
    with_id = hits.join(children.select(key, "parent_id"), key, "left").join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    unit = F.coalesce(F.when(F.col("parent_text").isNotNull(), F.concat(F.lit("p:"), F.col("parent_id").cast("string"))), F.concat(F.lit("c:"), F.col(key).cast("string")))
    w = Window.partitionBy("query_id", "_unit").orderBy("rank")
    return with_id.withColumn("_unit", unit).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_unit")


def adjacency(df: DataFrame, by: str, index: str, page: str | None = None, most: int = 2) -> DataFrame:
    """Runs of chunks whose index goes up by 1 to ``most``; without an index, whose pages are at most one apart."""
    w = Window.partitionBy(by).orderBy(index)
    apart = F.col(index) - F.lag(index).over(w)
    near = apart.between(1, most)
    if page:
        near = F.coalesce(near, F.abs(F.col(page) - F.lag(page).over(w)) <= 1)
    marked = df.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def budget_fill(items: Column, cap: int | Column) -> Column:
    """Which of an ordered array of (tokens, ...) fit a budget: one that doesn't is skipped, smaller ones are
    still tried, and the first always fits. A fold, as it isn't a prefix sum."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("first"), F.array().cast("array<boolean>").alias("out"))

    def step(s, x):
        fits = s["first"] | (s["used"] + x["tokens"] <= cap)
        return F.struct((s["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), F.lit(False).alias("first"), F.array_append(s["out"], fits).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def within_budget(df: DataFrame, by: str, order: list[Column], tokens: str, cap: int | Column) -> DataFrame:
    """The rows that ``budget_fill`` might take: of those of n tokens, the first cap / n + 1 in order.

    Once one of n tokens doesn't fit, none of as many does, so those of n tokens that fit are the
    first of their size. What is left depends on the budget, not on how many rows there are.
    """
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    n = F.col(tokens).cast("long")
    place = F.row_number().over(Window.partitionBy(by, F.least(n, cap + 1)).orderBy(*order))
    most = F.greatest(F.floor(cap / F.greatest(n, F.lit(1))), F.lit(0)) + 1
    return df.withColumn("_place", place).filter((F.col("_place") <= most) | (n == 0)).drop("_place")


def fill(df: DataFrame, by: str, order: str, tokens: str, cap: int) -> DataFrame:
    """The rows that fit, for each group. Only those that may fit meet in one row."""
    few = within_budget(df, by, [F.col(order), F.col(tokens), F.struct(*df.columns)], tokens, cap)
    grouped = few.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("tokens"), F.struct(*df.columns).alias("row")))).alias("_i"))
    kept = grouped.select(F.explode(F.arrays_zip("_i", budget_fill(F.col("_i"), cap).alias("fits"))).alias("z"))
    return kept.filter("z.fits").select("z._i.row.*")


def containment_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int = 8, least: float = 0.8) -> DataFrame:
    """left_key, right_key, shared, containment of pairs whose shared n-word runs reach ``least`` of the right text's.

    An equi-join on runs of words; runs that stand in one side only are never paired.
    """
    # runs travel as 64-bit hashes with the side's number of runs; few enough pairs come out to check them on words
    hashed = lambda df, key, size: df.select(F.col(key), F.explode(text.let(F.transform(text.shingles(F.col("text"), n), lambda x: F.xxhash64(x)), lambda g: F.transform(g, lambda x: F.struct(x.alias("gram"), F.size(g).alias(size))))).alias("g")).select(key, "g.*")
    a, b = hashed(left, left_key, "_n").drop("_n"), hashed(right, right_key, "_size")
    near = a.join(b, "gram").groupBy(left_key, right_key, "_size").agg(F.count("*").alias("_shared")).filter(F.round(F.col("_shared") / F.col("_size"), 6) >= least).select(left_key, right_key)
    texts = near.join(left.select(left_key, F.col("text").alias("_l")), left_key).join(right.select(right_key, F.col("text").alias("_r")), right_key)
    both = text.let(text.shingles(F.col("_r"), n), lambda r: F.struct(F.size(F.array_intersect(r, text.shingles(F.col("_l"), n))).cast("long").alias("shared"), F.size(r).alias("size")))
    exact = texts.select(left_key, right_key, both.alias("_x")).select(left_key, right_key, "_x.shared", F.round(F.col("_x.shared") / F.col("_x.size"), 6).alias("containment"))
    return exact.filter(F.col("containment") >= least)


def greedy_dedup(units: DataFrame, by: str, order: str, key: str, n: int = 8, least: float = 0.8) -> DataFrame:
    """Units in order, without those an earlier kept one repeats or contains. A pool may be of any size.

    Of units with equal texts only the first can stay. A unit meets the earlier ones that hold one
    of its rarest runs of words: it needs ``least`` of its runs in the other, so one of any
    1 - ``least`` of them and one more. Then the pairs are settled in rounds: a unit goes if one
    that is sure to stay contains it, and is sure to stay once all that contain it are gone.
    """
    runs = F.transform(text.shingles(F.coalesce("text", F.lit("")), n), lambda x: F.xxhash64(x))
    place = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    flat = units.select(F.col(by), place.alias("p"), text.normalise_context(F.coalesce("text", F.lit(""))).alias("t"), runs.alias("r"))
    first = flat.groupBy(by, "t").agg(F.min("p").alias("p"), F.first("r").alias("r"))
    pool = settled(first.select(by, "p", "r", F.monotonically_increasing_id().alias("id"), F.size("r").alias("n")))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-6))
    held = pool.select(F.col(by).alias("_by"), "p", "id", "n", F.explode("r").alias("run"))
    often = held.groupBy(F.col("_by").alias("_in"), F.col("run").alias("_run")).agg(F.count("*").alias("c"))
    counted = settled(held.join(often, F.col("_by").eqNullSafe(F.col("_in")) & (F.col("run") == F.col("_run"))).drop("_in", "_run"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("c", "run"))
    asks = counted.withColumn("_at", rarest).filter((F.col("_at") <= F.col("n") - need + 1) & (F.col("c") > 1)).select("_by", "run", "p", F.col("id").alias("u"), need.alias("need"))
    there = counted.filter("c > 1").select(F.col("_by").alias("_in"), F.col("run").alias("_run"), F.col("p").alias("_p"), F.col("id").alias("k"), F.col("n").alias("_n"))
    met = asks.join(there, F.col("_by").eqNullSafe(F.col("_in")) & (F.col("run") == F.col("_run")) & (F.col("_p") < F.col("p")) & (F.col("_n") >= F.col("need"))).select("u", "k").distinct()
    both = met.join(pool.select(F.col("id").alias("u"), F.col("r").alias("ru")), "u").join(pool.select(F.col("id").alias("k"), F.col("r").alias("rk")), "k")
    pairs = settled(both.filter(F.size(F.array_intersect("ru", "rk")) >= F.size("ru") * least).select("u", "k"))
    gone = _contained(pairs)
    forget(counted)
    return pool.join(gone.withColumnRenamed("u", "id"), "id", "left_anti").select(by, F.col("p.k").alias(key))


def _contained(pairs: DataFrame) -> DataFrame:
    """Who goes, of settled pairs (u, k): u goes if k stays. No chain of pairs leads back."""
    gone = None
    while pairs.take(1):
        waiting = pairs.select(F.col("u").alias("k")).distinct()
        now = settled(pairs.join(waiting, "k", "left_anti").select("u").distinct())
        gone = now if gone is None else gone.union(now)
        further = settled(pairs.join(now, "u", "left_anti").join(now.select(F.col("u").alias("k")), "k", "left_anti").select("u", "k"))
        forget(pairs)
        pairs = further
    return pairs.select("u") if gone is None else gone


def table_assembly(parts: DataFrame, matched: DataFrame, most_parts: int = 6, most_tokens: int = 3000) -> DataFrame:
    """query_id, table_id, rows and whether the table is whole: all parts if few and short enough, else those that matched.

    ``parts``: table_id, part, rows (array), tokens, page; ``matched``: query_id, table_id, part.
    """
    sizes = parts.groupBy("table_id").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_tokens")).withColumn("complete", (F.col("_n") <= most_parts) & (F.col("_tokens") <= most_tokens))
    wanted = matched.select("query_id", "table_id").distinct().join(sizes, "table_id").join(parts, "table_id")
    hit = matched.select("query_id", "table_id", "part", F.lit(True).alias("_hit")).distinct()
    kept = wanted.join(hit, ["query_id", "table_id", "part"], "left").filter(F.col("complete") | F.col("_hit"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "rows")))
    return kept.groupBy("query_id", "table_id", "complete").agg(F.flatten(F.transform(ordered, lambda p: p["rows"])).alias("rows"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.count("*").alias("n_parts"))


def group_blocks(df: DataFrame, by: list[str], order: str, agreed: list[str]) -> DataFrame:
    """One block per group: texts in order, page span, and each ``agreed`` column's value if all rows share it."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    same = [F.when(F.countDistinct(c) == 1, F.min(c)).otherwise(F.lit("")).alias(c) for c in agreed]
    return df.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"), F.min("page").alias("page"), F.max("page").alias("page_end"), *same)


def section_coverage(openers: DataFrame, present: DataFrame, doc: str, section: str) -> DataFrame:
    """Sections of the outline none of whose opening chunks is present."""
    return openers.join(present.select(doc, section).distinct(), [doc, section], "left_anti")


def shared_provenance(used: DataFrame, by: str) -> DataFrame:
    """How many different places an answer draws on, and whether from more than one."""
    return used.groupBy(by).agg(F.countDistinct("source", "section").alias("n_places"), F.countDistinct("source").alias("n_sources")).withColumn("multi_hop", F.col("n_places") > 1)


def expand(hits: DataFrame, chunks: DataFrame, parents: DataFrame, parts: DataFrame, plans: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits widened in three steps, in this order: neighbours, parents, the rest of their tables.

    ``hits``: query_id, key, rank, score; ``chunks``: key, prev_id, next_id, parent_id, table_id,
    text; ``parents``: parent_id, text; ``parts``: table_id, part, rows, tokens, page and key;
    ``plans``: query_id, neighbours. Gives query_id, unit (what it is), text, rank. A table's parts
    stand in the place of the first of them and have neither neighbours nor parents.
    """
    of = chunks.select(key, "parent_id", "table_id", "text")
    wide = hits.join(plans.filter("neighbours").select("query_id"), "query_id", "left_semi")
    near = neighbour_expand(wide.join(of.filter("table_id IS NULL").select(key), key), chunks, key).join(hits.select("query_id", F.col(key).alias("expanded_from"), "rank"), ["query_id", "expanded_from"])
    rows = hits.select("query_id", key, "rank", F.lit(0).alias("_after")).unionByName(near.select("query_id", key, "rank", F.lit(1).alias("_after")))
    rows = rows.join(of, key)
    prose, tables = rows.filter("table_id IS NULL"), rows.filter("table_id IS NOT NULL")
    whole = prose.join(parents.select("parent_id", F.col("text").alias("_parent")), "parent_id", "left")
    unit = F.coalesce(F.when(F.col("_parent").isNotNull(), F.concat(F.lit("p:"), F.col("parent_id").cast("string"))), F.concat(F.lit("c:"), F.col(key).cast("string")))
    prose_units = whole.select("query_id", unit.alias("unit"), F.coalesce("_parent", "text").alias("text"), "rank", "_after")
    matched = tables.join(parts.select(key, "part"), key).select("query_id", "table_id", "part")
    at = tables.groupBy("query_id", "table_id").agg(F.min("rank").alias("rank"))
    assembled = table_assembly(parts, matched).join(at, ["query_id", "table_id"])
    table_units = assembled.select("query_id", F.concat(F.lit("t:"), F.col("table_id").cast("string")).alias("unit"), F.array_join("rows", "\n").alias("text"), "rank", F.lit(0).alias("_after"))
    first = Window.partitionBy("query_id", "unit").orderBy("rank", "_after")
    once = prose_units.unionByName(table_units).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return once.select("query_id", "unit", "text", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "_after", "unit")).alias("rank"))


def outline_lines(outline: DataFrame, most: int = 40) -> DataFrame:
    """query_id, outline: the first ``most`` sections of a question's documents, as a block of lines."""
    place = Window.partitionBy("query_id").orderBy("source", "page", "section")
    rows = outline.withColumn("_n", F.row_number().over(place))
    line = F.concat(F.lit("  - "), "section", F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    shown = rows.filter(F.col("_n") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "\n").alias("_lines"))
    titles = outline.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("_titles"))
    return shown.join(titles, "query_id").select("query_id", F.concat(F.lit("[Document outline: "), "_titles", F.lit("]\n"), "_lines").alias("outline"))


def assemble(units: DataFrame, plans: DataFrame, outline: DataFrame | None = None, n: int = 8, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The context of each question, and the units that it was made from: (query_id, text, n_blocks), (query_id, unit, block).

    ``units``: query_id, unit, source, section, page, page_end, chunk_index, content_type, text,
    relevance; ``plans``: query_id, context_tokens, document_order, merge (join what stands
    together). Repeats go, what stands together is joined, the best that fit the budget stay, and
    units of one section form a block. Blocks stand in order of the document, or the best at both ends.
    """
    order = F.struct(-F.col("relevance"), F.col("unit"))
    rows = units.withColumn("_order", order)
    kept = rows.join(greedy_dedup(rows, "query_id", "_order", "unit", n, least), ["query_id", "unit"], "left_semi").join(plans, "query_id")
    w = Window.partitionBy("query_id", "source", "section").orderBy("chunk_index", "unit")
    apart = ~(F.coalesce(F.col("merge") & (F.col("chunk_index") - F.lag("chunk_index").over(w)).between(1, 2), F.lit(False)))
    run = kept.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "unit", "text")))
    merged = run.groupBy("query_id", "source", "section", "_run").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.transform(ordered, lambda x: x["unit"]).alias("members"), F.max("relevance").alias("relevance"),
        F.min("page").alias("page"), F.max("page_end").alias("page_end"), F.min("chunk_index").alias("chunk_index"), F.when(F.countDistinct("content_type") == 1, F.min("content_type")).otherwise("").alias("content_type"),
        F.first("context_tokens").alias("context_tokens"), F.first("document_order").alias("document_order"),
    )
    ranked = merged.withColumn("tokens", text.word_count_tokens(F.col("text")).cast("long")).withColumn("_at", F.struct((-F.col("relevance")).alias("r"), "source", "section", "_run"))
    few = within_budget(ranked, "query_id", [F.col("_at")], "tokens", F.col("context_tokens"))
    pools = few.groupBy("query_id", "context_tokens").agg(F.array_sort(F.collect_list(F.struct("_at", "tokens", F.struct(*ranked.columns).alias("row")))).alias("_i"))
    fits = pools.select(F.explode(F.arrays_zip("_i", budget_fill(F.col("_i"), F.col("context_tokens")).alias("fits"))).alias("z")).filter("z.fits").select("z._i.row.*")
    blocks = fits.groupBy("query_id", "source", "section", "document_order").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "_run", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.flatten(F.collect_list("members")).alias("members"), F.max("relevance").alias("relevance"),
        F.min("page").alias("page"), F.max("page_end").alias("page_end"), F.min("chunk_index").alias("chunk_index"), F.when(F.countDistinct("content_type") == 1, F.min("content_type")).otherwise("").alias("content_type"),
    )
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "source", "section"))
    placed = blocks.withColumn("_best", best).withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    ends = F.when((F.col("_n") <= 2) | (F.col("_best") % 2 == 1), F.col("_best")).otherwise(F.lit(1 << 30) - F.col("_best"))
    place = Window.partitionBy("query_id").orderBy(F.when(F.col("document_order"), F.col("source")), F.when(F.col("document_order"), F.col("chunk_index")), ends)
    numbered = placed.withColumn("block", F.row_number().over(place))
    kind = F.when((F.col("content_type") != "") & (F.col("content_type") != "other"), F.concat(F.lit(" ["), "content_type", F.lit("]"))).otherwise("")
    trail = F.when(F.col("section") != "", F.concat(F.lit(", section: "), "section")).otherwise("")
    label = F.concat(F.lit("["), F.col("block").cast("string"), F.lit("] "), text.citation_label(F.col("source"), F.lit(""), F.col("page"), F.col("page_end")), trail, kind)
    part = F.concat(label, F.lit("\n"), text.strip(F.col("text")))
    whole = numbered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", part.alias("p")))), lambda x: x["p"]).alias("_parts"), F.count("*").alias("n_blocks"))
    if outline is not None:
        whole = whole.join(outline_lines(outline), "query_id", "left").withColumn("_parts", F.concat(F.when(F.col("outline").isNotNull(), F.array("outline")).otherwise(F.array().cast("array<string>")), "_parts"))
    used = numbered.select("query_id", F.explode("members").alias("unit"), "block")
    return whole.select("query_id", F.array_join("_parts", "\n\n---\n\n").alias("text"), "n_blocks"), used


# ---------------------------------------------------------------- coverage of an outline

# The shortest heading and the least tokens of a section that counts as major, and the
# score above which coverage stands where nothing is reranked.
LEAST_HEADING, LEAST_SECTION, COVERAGE_SCORE = 4, 60, 2.0


def with_coverage(units: DataFrame, chunks: DataFrame, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with the opening chunk of every major section that lacks it, and a report.

    ``units`` as for ``assemble``; ``chunks``: unit, source, section, page, page_end, chunk_index,
    content_type, text, tokens; ``routed``: query_id, source, the documents that coverage keeps to.
    An added unit scores half a point above the best of its question and is marked ``coverage``. The
    report: query_id, outline_sections, major_sections, covered_before, added. A section is
    represented by its opening chunk alone, as that says what it is about.
    """
    place = Window.partitionBy("source", "section").orderBy("chunk_index", "unit")
    named = chunks.filter(text.strip(F.coalesce("section", F.lit(""))) != "")
    sized = named.groupBy("source", "section").agg(F.sum("tokens").alias("_tokens"))
    openers = named.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n").join(sized, ["source", "section"])
    major = (F.length(text.strip(F.col("section"))) >= LEAST_HEADING) & (F.col("_tokens") >= LEAST_SECTION)
    wanted = openers.withColumn("_major", major).join(routed.select("query_id", "source").distinct(), "source")
    marked = wanted.join(units.select("query_id", "unit", F.lit(True).alias("_there")), ["query_id", "unit"], "left")
    best = units.groupBy("query_id").agg(F.max("relevance").alias("_best"))
    new = marked.filter(F.col("_major") & F.col("_there").isNull()).join(best, "query_id", "left").withColumn("relevance", F.coalesce("_best", F.lit(COVERAGE_SCORE)) + 0.5)
    both = units.withColumn("coverage", F.lit(False)).unionByName(new.select(*units.columns, F.lit(True).alias("coverage")))
    count = lambda c: F.count_if(c).alias
    report = marked.groupBy("query_id").agg(F.count("*").alias("outline_sections"), count(F.col("_major"))("major_sections"), count(F.col("_major") & F.col("_there").isNotNull())("covered_before"), count(F.col("_major") & F.col("_there").isNull())("added"))
    return both, report


def missing_coverage(units: DataFrame, used: DataFrame) -> DataFrame:
    """Coverage units none of whose section's units made it into the context; headings are compared without numbers and case."""
    heading = text.normalise_item(F.col("section"))
    there = units.join(used.select("query_id", "unit"), ["query_id", "unit"], "left_semi").select("query_id", heading.alias("_h")).distinct()
    return units.filter("coverage").withColumn("_h", heading).join(there, ["query_id", "_h"], "left_anti").drop("_h")


def covered_context(units: DataFrame, chunks: DataFrame, routed: DataFrame, plans: DataFrame, outline: DataFrame | None = None, widen: float = 1.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``assemble``, with the outline covered: the context, its units, and the report with what still lacks.

    Where the budget has dropped a section that was added, the question is assembled once more with
    ``widen`` times the budget and only its coverage and the units that were used; what doesn't
    fit then either is reported (``still_missing``, sections).
    """
    full, report = with_coverage(units, chunks, routed)
    full = settled(full)
    bare = full.drop("coverage")
    context, used = assemble(bare, plans, outline)
    used = settled(used)
    again = settled(missing_coverage(full, used).select("query_id").distinct())
    wider = plans.join(again, "query_id", "left_semi").withColumn("context_tokens", F.floor(F.col("context_tokens") * widen).cast(plans.schema["context_tokens"].dataType))
    pinned = full.join(again, "query_id", "left_semi").join(used.select("query_id", "unit", F.lit(True).alias("_used")), ["query_id", "unit"], "left").filter(F.col("coverage") | F.col("_used"))
    context2, used2 = assemble(pinned.select(*bare.columns), wider, outline.join(again, "query_id", "left_semi") if outline is not None else None)
    whole = context.join(again, "query_id", "left_anti").unionByName(context2)
    all_used = settled(used.join(again, "query_id", "left_anti").unionByName(used2))
    lacking = missing_coverage(full, all_used).groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat("source", F.lit(": "), "section"))).alias("still_missing"))
    told = report.join(lacking, "query_id", "left").withColumn("still_missing", F.coalesce("still_missing", F.array().cast("array<string>")))
    return whole, all_used, told
