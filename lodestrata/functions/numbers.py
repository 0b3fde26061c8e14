"""Numbers in text, vectors, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def leading_number(text: Column) -> Column:
    """The first number in a text; null where there is none, so that "N/A" is never 0."""
    return F.regexp_replace(F.regexp_extract(text, f"({NUMBER})", 1), ",", "").try_cast("double")


def number_after(text: Column, cue: Column) -> Column:
    """The first number after the first occurrence of ``cue``."""
    at = F.instr(F.lower(text), cue)
    tail = F.substring(text, at + F.length(cue), F.length(text))
    return F.when((at > 0) & (cue != ""), leading_number(tail))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; null where a vector has no length."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def max_sim(query: Column, page: Column) -> Column:
    """Sum over the query's vectors of the best dot product with any of the page's."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(page, lambda p: dot(q, p)))), F.lit(0.0), lambda s, x: s + x)
