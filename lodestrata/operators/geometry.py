"""Tables from positions: rows from baselines, columns from gaps, and columns that a detected table has lost.

Spans are texts with their rectangle (x0, y0, x1, y1, y down the page). Everything is intervals on
a page: sorted by one coordinate, a span that begins beyond all before it opens a new group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: How far a coordinate may be off.
NEAR, ASIDE = 1.0, 2.0


def intervals(df: DataFrame, by: list[str], low: str, high: str, name: str, gap: float = 0.0) -> DataFrame:
    """Numbers from 0 the groups of intervals that overlap or lie no more than ``gap`` apart."""
    order = Window.partitionBy(*by).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(low) > before + gap), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1).drop("_opens")


def _joined(value: str = "text") -> Column:
    """Texts of a cell from left to right, line by line."""
    listed = F.array_sort(F.collect_list(F.struct("y0", "x0", F.col(value).alias("t"))))
    return text.strip(F.array_join(F.transform(listed, lambda x: x["t"]), " "))


def grid(spans: DataFrame, page: list[str], gap: float = 4.0) -> DataFrame:
    """page, row_no, col_no, text of a borderless table: spans of one region a page.

    Rows are groups of spans by the middle half of their height, so lines that touch stay apart;
    columns are groups by their width over all rows, ``gap`` apart at least. A span that reaches over
    several columns joins them, as nothing tells where its parts belong.
    """
    full = spans.filter(text.strip(F.coalesce("text", F.lit(""))) != "")
    quarter = (F.col("y1") - F.col("y0")) / 4
    rows = intervals(full.withColumn("_top", F.col("y0") + quarter).withColumn("_low", F.col("y1") - quarter), page, "_top", "_low", "row_no")
    cells = intervals(rows, page, "x0", "x1", "col_no", gap)
    return cells.groupBy(*page, "row_no", "col_no").agg(_joined().alias("text"))


def orphans(spans: DataFrame, rects: DataFrame, page: list[str]) -> DataFrame:
    """Spans in the row band of a table (page, table_no, x0, y0, x1, y1) but beside it, and on which side."""
    band = rects.select(*page, "table_no", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = spans.join(band, page)  # a page has few tables
    inside = (F.col("y0") >= F.col("t_y0") - NEAR) & (F.col("y1") <= F.col("t_y1") + NEAR)
    side = F.when(F.col("x1") < F.col("t_x0") - ASIDE, "left").when(F.col("x0") > F.col("t_x1") + ASIDE, "right")
    return both.withColumn("side", side).filter(inside & F.col("side").isNotNull()).select(*page, "table_no", "side", "x0", "y0", "x1", "y1", "text")


def recovered(rows: DataFrame, spans: DataFrame, rects: DataFrame, page: list[str]) -> DataFrame:
    """Detected rows with the columns that their table has lost: page, table_no, row_no, cells, repaired.

    ``rows``: page, table_no, row_no, y0, y1, cells (array); row 0 is the header. A span beside the
    table goes to the row whose band holds it. A side is believed only if the header and every row
    that isn't blank get a value from it; unless all sides that have spans are believed the
    table stays as it was.
    """
    key = [*page, "table_no"]
    beside = orphans(spans, rects, page)
    band = rows.select(*key, "row_no", F.col("y0").alias("r_y0"), F.col("y1").alias("r_y1"))
    placed = beside.join(band, key).filter((F.col("y0") >= F.col("r_y0") - NEAR) & (F.col("y1") <= F.col("r_y1") + NEAR))
    found = placed.groupBy(*key, "row_no", "side").agg(_joined().alias("value"))
    sides = found.groupBy(*key, "row_no").agg(F.max(F.when(F.col("side") == "left", F.col("value"))).alias("_left"), F.max(F.when(F.col("side") == "right", F.col("value"))).alias("_right"))
    has = beside.groupBy(*key).agg(F.max(F.col("side") == "left").alias("_has_left"), F.max(F.col("side") == "right").alias("_has_right"))
    filled = F.exists("cells", lambda c: text.strip(F.coalesce(c, F.lit(""))) != "") | (F.col("row_no") == 0)
    lacks = lambda side: F.col(f"_has{side}") & filled & (F.coalesce(side, F.lit("")) == "")
    joined = rows.join(has, key, "left").join(sides, [*key, "row_no"], "left")
    judged = joined.withColumn("_ok", F.col("_has_left").isNotNull() & ~F.max(F.coalesce(lacks("_left") | lacks("_right"), F.lit(False))).over(Window.partitionBy(*key)))
    none = F.array().cast("array<string>")
    more = lambda side: F.when(F.col("_ok") & F.col(f"_has{side}"), F.array(F.coalesce(side, F.lit("")))).otherwise(none)
    return judged.select(*key, "row_no", F.concat(more("_left"), "cells", more("_right")).alias("cells"), F.col("_ok").alias("repaired"))
