"""The contract of a chunk: which fields it has, of what type, and what stands where one is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contract fields, types and defaults.
CONTRACT = {
    "source": ("string", ""),
    "page": ("int", 0),
    "chunk_index": ("int", 0),
    "user_id": ("string", ""),
    "heading_path": ("string", ""),
    "section_title": ("string", ""),
    "content_type": ("string", "other"),
    "topics": ("array<string>", []),
    "entities": ("array<string>", []),
    "answers_questions": ("array<string>", []),
    "table_id": ("string", ""),
    "table_part": ("int", 0),
    "table_total_parts": ("int", 0),
    "table_headers": ("array<string>", []),
    "extraction_mode": ("string", "text"),
}
PROMPT_VISIBLE = ["source", "page", "heading_path", "content_type"]
CONTENT_TYPES = ["policy", "procedure", "table", "definition", "other"]
DELIMITER = ", "


def _default(kind: str, value) -> Column:
    return F.array().cast(kind) if kind.startswith("array") else F.lit(value).cast(kind)


def split_list(text: Column) -> Column:
    """A delimited string as an array without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def join_list(values: Column) -> Column:
    return F.array_join(values, DELIMITER)


def apply_defaults(df: DataFrame) -> DataFrame:
    """Every contract field, cast where it can be and else its default; other columns stay."""
    have = dict(df.dtypes)
    out = df
    for name, (kind, value) in CONTRACT.items():
        if name not in have:
            column = _default(kind, value)
        elif kind.startswith("array") and have[name] == "string":
            column = F.coalesce(split_list(F.col(name)), _default(kind, value))
        elif have[name] == kind or kind.startswith("array"):
            column = F.coalesce(F.col(name), _default(kind, value))
        else:
            column = F.coalesce(F.col(name).try_cast(kind), _default(kind, value))
        out = out.withColumn(name, column)
    return out


def violations(df: DataFrame, key: str) -> DataFrame:
    """key, field and problem of every contract breach: a field missing, null, or not of its set."""
    have = dict(df.dtypes)
    checks = []
    for name, (kind, _) in CONTRACT.items():
        if name not in have:
            checks.append(F.struct(F.lit(name).alias("field"), F.lit("missing").alias("problem")))
            continue
        problem = F.when(F.col(name).isNull(), "null")
        if name == "content_type":
            problem = problem.when(~F.col(name).isin(CONTENT_TYPES), "unknown value")
        if have[name] != kind and not (kind == "int" and have[name] == "bigint"):
            problem = problem.otherwise(F.lit("wrong type"))
        checks.append(F.when(problem.isNotNull(), F.struct(F.lit(name).alias("field"), problem.alias("problem"))))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*checks))).alias("v")).select(key, "v.field", "v.problem")


def storage_safe(df: DataFrame, columns: list[str], into: str = "metadata") -> DataFrame:
    """The columns as one map of strings without nulls."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.withColumn(into, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def prompt_projection(df: DataFrame, *extra: str) -> DataFrame:
    """Only what a reader of the context may see."""
    return df.select(*extra, *PROMPT_VISIBLE)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
