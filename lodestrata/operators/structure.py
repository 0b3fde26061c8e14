"""Document structure: lines, headings, sections, chunks, links, tables over pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def blocks(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """key, block_no from 0, line: every line in order, the order kept in a column of its own."""
    return docs.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("block_no", "line"))


def running_lines(lines: DataFrame, doc: str, page: str, ratio: float = 0.6, first: int = 2, last: int = 3, most: int = 120) -> DataFrame:
    """doc, line of margin lines that stand on most pages: ``lines`` has doc, page, line_no, line."""
    up = F.row_number().over(Window.partitionBy(doc, page).orderBy("line_no"))
    down = F.row_number().over(Window.partitionBy(doc, page).orderBy(F.desc("line_no")))
    margin = lines.withColumn("_line", text.strip(F.col("line"))).withColumn("_u", up).withColumn("_d", down).filter(((F.col("_u") <= first) | (F.col("_d") <= last)) & (F.length("_line") <= most) & (F.col("_line") != ""))
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("_pages")).filter("_pages >= 3")
    seen = margin.groupBy(doc, F.col("_line").alias("line")).agg(F.countDistinct(page).alias("n_pages"))
    return seen.join(pages, doc).filter(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * ratio))).select(doc, "line", "n_pages")


def drop_running_lines(lines: DataFrame, running: DataFrame, doc: str, page: str) -> DataFrame:
    """Without them, on all pages but the first."""
    out = lines.withColumn("_line", text.strip(F.col("line"))).join(running.select(doc, F.col("line").alias("_line"), F.lit(True).alias("_hit")), [doc, "_line"], "left")
    return out.filter(F.col("_hit").isNull() | (F.col(page) == 1)).drop("_line", "_hit")


def carry_forward(df: DataFrame, by: str, order: str, opens: Column, value: Column, name: str = "section") -> DataFrame:
    """Each row gets the value of the last row that opens a section."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(opens, value), ignorenulls=True).over(w))


def runs(df: DataFrame, by: str, order: str, changed: Column, name: str = "run_no") -> DataFrame:
    """Numbers unbroken runs from 1; ``changed`` says whether a row opens a new one."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_c", changed).withColumn(name, F.sum(F.when(F.coalesce("_c", F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def links(df: DataFrame, by: str, order: str, key: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("prev_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w))


def heading_levels(df: DataFrame, by: str, order: str, level: str, title: str, depth: int = 3) -> DataFrame:
    """The path of headings above each row: a heading ends deeper ones. ``level`` is null for other rows."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for k in range(1, depth + 1):
        # where the level itself opens, its title; where a shallower one opens, nothing
        mark = F.when(F.col(level) == k, F.struct(F.col(title).alias("t"))).when(F.col(level) < k, F.struct(F.lit("").alias("t")))
        out = out.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(w)["t"])
    parts = F.filter(F.array(*[F.coalesce(f"_h{k}", F.lit("")) for k in range(1, depth + 1)]), lambda x: x != "")
    return out.withColumn("heading_path", F.array_join(parts, " > ")).drop(*[f"_h{k}" for k in range(1, depth + 1)])


def packed(df: DataFrame, by: list[str], order: list[str], tokens: str, cap: int, most: int | None = None, name: str = "chunk_no") -> DataFrame:
    """``df`` with its rows packed greedily, in order, into groups numbered from 0 within ``by``.

    A group is closed when the next row would take it beyond ``cap`` tokens (or ``most`` rows); a
    row larger than ``cap`` stands alone. A number depends on all rows before, so each group of
    ``by`` is read once in its order; no more than a batch of it is held.
    """
    rows = df.withColumn("_size", F.coalesce(F.col(tokens), F.lit(0)).cast("long")).withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)

    def run(batches):
        group, used, count = 0, 0, 0
        for batch in batches:
            out = []
            for size, first in zip(batch.column("_size").to_pylist(), batch.column("_first").to_pylist(), strict=True):
                if first:
                    group, used, count = 0, 0, 0
                elif used + size > cap or count == most:
                    group, used, count = group + 1, 0, 0
                used, count = used + size, count + 1
                out.append(group)
            kept = batch.drop_columns(["_size", "_first"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=[*kept.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    return rows.mapInArrow(run, schema)


def pack_blocks(df: DataFrame, by: list[str], order: str, text_col: str, cap: int, most: int | None = None) -> DataFrame:
    """by, chunk_no, text, n_blocks, tokens: the blocks of each section packed to ``cap`` tokens, in order."""
    items = df.select(*by, F.col(order).alias("o"), text.word_count_tokens(F.col(text_col)).alias("tokens"), F.col(text_col).alias("text"))
    flat = packed(items, by, ["o", "tokens", "text"], "tokens", cap, most)
    return flat.groupBy(*by, "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_blocks"), F.sum("tokens").alias("tokens"))


def splice(chunks: DataFrame, tables: DataFrame, by: str, order: str, page: str) -> DataFrame:
    """Tables among text chunks: after the last chunk of their page or an earlier one; then numbered anew from 0."""
    a = chunks.select("*", F.lit(0).alias("_kind"))
    b = tables.select("*", F.lit(1).alias("_kind"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(page, "_kind", F.col(order).asc_nulls_last())
    return both.withColumn("chunk_index", F.row_number().over(w) - 1).drop("_kind")


def stitch(fragments: DataFrame, doc: str) -> DataFrame:
    """Fragments of a table that goes on over a page break, numbered as logical tables.

    ``fragments``: doc, fragment_no, page, width, first_on_page, last_on_page. A fragment carries
    on if it is first on the next page, the one before was last on its page, and both are as wide.
    """
    w = Window.partitionBy(doc).orderBy("page", "fragment_no")
    goes_on = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("width") == F.lag("width").over(w)) & F.lag("last_on_page").over(w) & F.col("first_on_page")
    marked = fragments.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("table_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def stitched_rows(rows: DataFrame, fragments: DataFrame, doc: str) -> DataFrame:
    """Rows of the logical tables, without blank rows and without headers that a page repeats.

    ``rows``: doc, fragment_no, row_no, cells. The first row of a table is its header.
    """
    blank = ~F.exists("cells", lambda c: text.strip(F.coalesce(c, F.lit(""))) != "")
    same = lambda c: F.transform(c, lambda x: F.lower(text.squeeze(F.coalesce(x, F.lit("")))))
    joined = rows.join(stitch(fragments, doc).select(doc, "fragment_no", "page", "table_no"), [doc, "fragment_no"]).filter(~blank)
    w = Window.partitionBy(doc, "table_no").orderBy("page", "fragment_no", "row_no")
    head = joined.withColumn("_header", F.first("cells").over(w)).withColumn("_n", F.row_number().over(w))
    body = head.filter((F.col("_n") > 1) & ~((same(F.col("cells")) == same(F.col("_header"))) & (F.col("row_no") == 0)))
    return body.select(doc, "table_no", F.col("_header").alias("header"), "page", (F.row_number().over(Window.partitionBy(doc, "table_no").orderBy("_n")) - 1).alias("row_index"), "cells")


def nearest_heading(df: DataFrame, by: str, order: str, heading: Column, own: Column) -> DataFrame:
    """The last heading before each row that isn't its own header."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("section", F.last(F.when(~heading.eqNullSafe(own), heading), ignorenulls=True).over(w))


def uncovered_blocks(page_blocks: DataFrame, rects: DataFrame, page: list[str], share: float = 0.5) -> DataFrame:
    """Blocks that no table rectangle of their page covers by more than ``share`` of their area."""
    width = F.greatest(F.lit(0.0), F.least("x1", "_x1") - F.greatest("x0", "_x0"))
    height = F.greatest(F.lit(0.0), F.least("y1", "_y1") - F.greatest("y0", "_y0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    other = rects.select(*page, *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = page_blocks.join(other, page).filter((area > 0) & (width * height > share * area)).select(*page, "block_no").distinct()
    return page_blocks.join(hit, [*page, "block_no"], "left_anti")


def forward_positions(wanted: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """For each wanted text after a cursor, the first line from there on that holds it."""
    hits = wanted.join(lines, by).filter((F.col("line_no") >= F.col("cursor")) & (text.squeeze(F.col("line")) == text.squeeze(F.col("wanted"))))
    return hits.groupBy(by, "wanted", "cursor").agg(F.min("line_no").alias("line_no"))


def parent_numbers(headings: DataFrame, by: str) -> DataFrame:
    """Numbered headings with the title of the section above: '2.3.1 A' under '2.3 B'."""
    number = F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+", 1)
    numbered = headings.withColumn("number", number).filter("number <> ''")
    parents = numbered.groupBy(by, F.col("number").alias("_up")).agg(F.min_by("title", "ordinal").alias("parent_title"))
    return numbered.withColumn("_up", F.regexp_replace("number", r"\.?\d+$", "")).join(parents, [by, "_up"], "left").drop("_up")
