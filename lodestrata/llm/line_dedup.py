"""Removing lines that repeat across the corpus, by overlapping windows of three lines.

The lines of a text that hold a word are numbered; every three in a row are a window, named by
a 128-bit hash. A window's first occurrence, in the order of id and position, stays. Every later
one is covered, and a line goes if any covered window lies over it. What is counted is one row
per window; a hot window meets others as a partial minimum, and its later occurrences are found
by a join that can split it.

Defined cases: lines without a word are in no window and stay; very long texts are read whole; other
columns, whatever their names, are packed and never read; texts of fewer than three lines
with words have no window; a null text gives null; rows that agree in id and text are the same
document, so they aren't repeats of each other; a null id comes before any other; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_or_empty

LINES = 3


def _line_windows(size: int):
    """Places in the text of a window's lines, and its hash, for each window of an array of (place, line)."""

    def made(lines):
        at = lambda i, k: F.get(lines, i + k)["line"]
        one = lambda i: F.xxhash64(*[at(i, k) for k in range(size)])
        two = lambda i: F.xxhash64(F.lit("second"), *[at(i, k) for k in reversed(range(size))])
        window = lambda x, i: F.struct(F.array(*[F.get(lines, i + k)["place"] for k in range(size)]).alias("places"), one(i).alias("h1"), two(i).alias("h2"))
        return F.slice(F.transform(lines, window), F.lit(1), F.greatest(F.size(lines) - (size - 1), F.lit(0)))

    return made


def worded(text):
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("place"), x.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))


def repeated_windows(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text_hash and the places ``_gone`` of lines of documents that lose any."""
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    found = texts.select("_id", F.xxhash64("_text").alias("_text_hash"), F.explode(let(worded("_text"), _line_windows(size))).alias("w"))
    rows = materialise(found.select("_id", "_text_hash", "w.*"), "windows")
    place = F.struct("_id", "_text_hash", "places")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h1", "h2", "first")
    firsts = materialise(firsts, "firsts")  # both sides of the join are then dealt anew, and a hot window can be split
    later = rows.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    spans = later.groupBy("_id", "_text_hash").agg(F.collect_set("places").alias("windows"))
    return spans.select("_id", "_text_hash", F.array_distinct(F.flatten("windows")).alias("_gone"))


def line_dedup(docs: DataFrame, size: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: struct ``_row`` of its columns, n_lines, n_removed, clean_text."""
    gone = repeated_windows(docs, size, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_text"), F.xxhash64(text_or_empty(text_col)).alias("_h"))
    both = packed.join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text_hash")), "left")

    def cut(lines):
        rest = F.array_except(F.transform(lines, lambda _, i: i), F.col("_gone"))
        return F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")

    removed = F.coalesce(F.size("_gone"), F.lit(0))
    clean = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(let(F.split("_text", "\n"), cut))
    return both.select("_row", F.size(F.split(text_or_empty("_text"), "\n")).alias("n_lines"), F.greatest(removed, F.lit(0)).alias("n_removed"), clean.alias("clean_text"))
