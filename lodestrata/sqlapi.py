"""The engine's functions in SQL: temporary functions, and table functions in Python where text is taken apart."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

FUNCTIONS = {
    "bm25_tokens(t STRING) RETURNS ARRAY<STRING>": "regexp_extract_all(lower(t), '[a-z0-9]+(?:-[a-z0-9]+)*', 0)",
    "normalise_context(t STRING) RETURNS STRING": r"lower(regexp_replace(regexp_replace(t, '\\s+', ' '), '^\\s+|\\s+$', ''))",
    "normalise_item(t STRING) RETURNS STRING": r"lower(trim(regexp_replace(regexp_replace(t, '^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+', ''), '\\s+', ' ')))",
    "normalise_label(t STRING) RETURNS STRING": r"lower(regexp_replace(trim(regexp_replace(regexp_replace(t, '[()\\[\\]{}\\n]', ' '), '\\s+', ' ')), '^[^\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]+$', ''))",
    "leading_number(t STRING) RETURNS DOUBLE": r"try_cast(replace(regexp_extract(t, '(-?\\d[\\d,]*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE)",
}


class Spans:
    """Runs of 1 to 4 label tokens of a text, longest first."""

    def eval(self, question: str):
        import re

        tokens = [t for t in (re.sub(r"'s$|'$", "", x) for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9._'\-/%]*", (question or "").lower())) if t]
        for size in range(min(4, len(tokens)), 0, -1):
            for start in range(len(tokens) - size + 1):
                yield " ".join(tokens[start : start + size]), start, start + size


# Where a text may be cut, from the best place to the last resort.
SEPARATORS = ["\n\n", "\n", ". ", "; ", ", ", " ", ""]


def split_text(body: str, size: int, overlap: int, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the best separators there are, overlapping by whole parts."""
    separators = SEPARATORS if separators is None else separators
    if len(body) <= size:
        return [body] if body.strip() else []
    mark, rest = next(((s, separators[k + 1 :]) for k, s in enumerate(separators) if s == "" or s in body), ("", []))
    parts = [body[k : k + size] for k in range(0, len(body), size)] if mark == "" else [p + mark for p in body.split(mark)[:-1]] + [body.split(mark)[-1]]
    out: list[str] = []
    window: list[str] = []
    for part in parts:
        if len(part) > size:
            if window:
                out.append("".join(window))
                window = []
            out += split_text(part, size, overlap, rest)
            continue
        if window and sum(map(len, window)) + len(part) > size:
            out.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window.pop(0)
        window.append(part)
    if window:
        out.append("".join(window))
    return [x.strip() for x in out if x.strip()]


class Split:
    """Pieces of a text, numbered from 0."""

    def eval(self, body: str, size: int, overlap: int):
        yield from enumerate(split_text(body or "", size, overlap))


def register(spark: SparkSession, **views) -> None:
    """Temporary functions, table functions ``label_spans`` and ``split_text``, and the given DataFrames as views."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("label_spans", F.udtf(Spans, returnType="span string, start int, end int"))
    spark.udtf.register("split_text", F.udtf(Split, returnType="piece int, text string"))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
