"""Steps that need a model, as interfaces with defaults that run offline and always give the same.

A default is a stand-in, not a model: hashed bags of words for vectors, overlap of words for
reranking, patterns for the kind of a question, quoting for answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import numbers, text

DIMENSIONS = 64


def hashed_vector(value: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of length 1 from the hashes of a text's tokens (null for a text without tokens)."""
    tokens = text.bm25_tokens(value)
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    counts = lambda found: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(found, lambda s: s == k)).cast("double"))
    scaled = lambda v, size: F.when(size > 0, F.transform(v, lambda x: (x / size).cast("float")))
    return text.let(slots, lambda found: text.let(counts(found), lambda v: text.let(numbers.norm(v), lambda size: scaled(v, size))))


def overlap_score(question: Column, passage: Column) -> Column:
    """0 to 3: the share of the question's words that a passage holds."""
    asked = F.array_distinct(text.bm25_tokens(question))
    return F.when(F.size(asked) > 0, F.round(3.0 * F.size(F.array_intersect(asked, text.bm25_tokens(passage))) / F.size(asked))).otherwise(0.0).cast("int")


def quoted_answer(fact: Column, snippets: Column) -> Column:
    """An exact fact if there is one, then the first three snippets."""
    return F.concat_ws("\n", fact, F.array_join(F.slice(snippets, 1, 3), "\n"))


def structural_label(body: Column) -> Column:
    """The kind of content by its shape."""
    return F.when(body.rlike(r"(?m)^\s*\|.*\|\s*$"), "table").when(body.rlike(r"(?m)^\s*(?:\d+[.)]|step \d+)"), "procedure").when(body.rlike(r"(?i)\bmeans\b|\bis defined as\b"), "definition").when(body.rlike(r"(?i)\b(?:must|shall|policy|required)\b"), "policy").otherwise("other")


@dataclass(frozen=True)
class Plugins:
    """Column functions; each can be replaced, by a pandas UDF around a model for instance."""

    embed: Callable[[Column], Column] = hashed_vector
    classify: Callable[[Column], Column] = text.query_type
    rerank: Callable[[Column, Column], Column] = overlap_score
    generate: Callable[[Column, Column], Column] = quoted_answer
    label: Callable[[Column], Column] = structural_label
