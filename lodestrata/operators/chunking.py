"""Parent and child chunks: sections packed to a budget, tables whole, oversized blocks split with overlap.

A parent is what is read, its children are what is searched. Blocks (paragraphs, tables) of a
section are packed greedily into parents, and the blocks of a parent into children, so that a
child knows the pages of its own blocks. A block beyond the budget is split at the coarsest
separator that helps, and pieces of a child's split overlap. Packing depends on all blocks before,
so each section is a stream: sections are dealt to tasks by hash, a task reads its blocks in
order and holds no more than one parent at a time.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Where a block is split, the coarsest first.
SEPARATORS = ["\n\n", "\n", ". ", "; ", ", ", " ", ""]
#: As ``text.word_count_tokens`` counts.
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", re.ASCII)
_WITH_SPACE = re.compile(r"\s*(?:[A-Za-z0-9]+|[^A-Za-z0-9\s])|\s+$", re.ASCII)
TABLE_LINE = r"^\s*\|.*\|\s*$"


def count_tokens(value: str) -> int:
    return len(_TOKEN.findall(value))


def _atoms(value: str, size: int, level: int = 0) -> list[tuple[str, int]]:
    """Pieces of up to ``size`` tokens that make up the text, separators included, each with its tokens."""
    n = count_tokens(value)
    if n <= size or level == len(SEPARATORS):
        return [(value, n)]
    mark = SEPARATORS[level]
    parts = _WITH_SPACE.findall(value) if mark == "" else re.split(f"(?<={re.escape(mark)})", value)  # never within a token
    return [x for part in parts if part for x in _atoms(part, size, level + 1)]


def split_text(value: str, size: int, overlap: int = 0) -> list[tuple[str, int]]:
    """The text in pieces of up to ``size`` tokens; a piece begins with up to ``overlap`` tokens of the one before."""
    out, held, used, new = [], deque(), 0, False

    def close() -> None:
        piece = "".join(x for x, _ in held).strip()
        if piece:
            out.append((piece, used))  # no token lies in two atoms

    for atom, n in _atoms(value, size):
        if new and used + n > size:
            close()
            while held and (used > overlap or used + n > size):
                used -= held.popleft()[1]
            new = False
        held.append((atom, n))
        used, new = used + n, True
    if new:
        close()
    return out


Block = tuple[int, str, str, int]  # page, kind, text, tokens


def pack(blocks: Iterator[Block], size: int, overlap: int = 0) -> Iterator[tuple[str, int, int, bool, int, list[Block]]]:
    """Blocks in order to chunks: text, first and last page, whether it is a table, tokens, blocks."""
    held: list[Block] = []
    used = 0

    def closed():
        piece = "\n".join(b[2] for b in held).strip()
        return [(piece, min(b[0] for b in held), max(b[0] for b in held), False, used, held)] if piece else []

    for block in blocks:
        page, kind, value, n = block
        alone = kind == "table" or n > size
        if held and (alone or used + n > size):
            yield from closed()
            held, used = [], 0
        if kind == "table":
            yield value, page, page, True, n, [block]
        elif n > size:
            for piece, m in split_text(value, size, overlap):
                yield piece, page, page, False, m, [(page, kind, piece, m)]
        else:
            held.append(block)
            used += n
    if held:
        yield from closed()


def _chunked(by: list[str], child: int, overlap: int, parent: int):
    names = [*by, "parent_no", "child_no", "text", "page", "page_end", "has_table", "tokens"]

    def run(batches):
        def rows():
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
                yield from zip(keys, *(batch.column(c).to_pylist() for c in ("_page", "_kind", "_text")), strict=True)

        def sections():
            """(key, blocks) for each run of equal keys; blocks are drawn as they are needed."""
            ahead = next(stream, None)
            while ahead is not None:
                key = ahead[0]
                rest: list = [ahead]

                def own(key=key, rest=rest):
                    while rest[0] is not None and rest[0][0] == key:
                        _, page, kind, value = rest[0]
                        yield page, kind, value, count_tokens(value)
                        rest[0] = next(stream, None)

                yield key, own()
                ahead = rest[0]

        stream, out = rows(), []
        for key, blocks in sections():
            for p, (body, first, last, table, n, held) in enumerate(pack(blocks, parent)):
                out.append((*key, p, None, body, first, last, table, n))
                inner = [(body, first, last, table, n, held)] if table else pack(iter(held), child, overlap)
                out.extend((*key, p, c, piece, a, b, t, m) for c, (piece, a, b, t, m, _) in enumerate(inner))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    schema = None

    def with_schema(kind: pa.Schema):
        nonlocal schema
        schema = kind
        return run

    return with_schema


def blocks_of(lines: DataFrame, document: str, order: str, line: str = "line") -> DataFrame:
    """Lines in blocks: consecutive table lines are one table, other lines a paragraph each, blank ones none.

    ``lines``: document, order, page, line and what else, which is kept from a block's first line.
    """
    full = lines.filter(text.strip(F.col(line)) != "").withColumn("kind", F.when(F.col(line).rlike(TABLE_LINE), "table").otherwise("paragraph"))
    w = Window.partitionBy(document).orderBy(order)
    opens = (F.col("kind") == "paragraph") | (F.lag("kind").over(w) != "table") | F.lag("kind").over(w).isNull()
    numbered = full.withColumn("_opens", opens).withColumn("_block", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in lines.columns if c not in (document, line)]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(line).alias("_t"))))
    kept = [F.min_by(c, order).alias(c) for c in rest]
    return numbered.groupBy(document, "_block").agg(*kept, F.first("kind").alias("kind"), F.array_join(F.transform(listed, lambda x: x["_t"]), "\n").alias(line)).drop("_block")


def chunks(blocks: DataFrame, document: str, section: str, order: str, child: int = 350, overlap: int = 60, parent: int = 1600, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Parents and children of ``blocks`` (document, section, order, page, kind, line).

    Parents: document, section, parent_index, text, page, page_end, has_table, tokens. Children:
    the same with chunk_index, the parent they belong to, and the indexes before and after. Both are
    numbered from 0 through the document in order of section, so sections are numbers.
    """
    by = [document, section]
    rows = blocks.select(*by, F.col("page").cast("int").alias("_page"), F.col("kind").alias("_kind"), F.col(line).alias("_text"), F.col(order).alias("_order"))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "_order").select(*by, "_page", "_kind", "_text")
    ddl = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in by) + ", parent_no int, child_no int, text string, page int, page_end int, has_table boolean, tokens int"
    arrow = pa.schema([*((c, _arrow_type(blocks, c)) for c in by), ("parent_no", pa.int32()), ("child_no", pa.int32()), ("text", pa.string()), ("page", pa.int32()), ("page_end", pa.int32()), ("has_table", pa.bool_()), ("tokens", pa.int32())])
    both = dealt.mapInArrow(_chunked(by, child, overlap, parent)(arrow), ddl)
    # a parent stands before its children: both are numbered as they pass, so that blocks are packed once
    place = Window.partitionBy(document).orderBy(section, "parent_no", F.col("child_no").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda which: F.count_if(which).over(place).cast("int") - 1
    numbered = both.withColumn("parent_index", so_far(F.col("child_no").isNull())).withColumn("chunk_index", so_far(F.col("child_no").isNotNull()))
    parents, children = numbered.filter("child_no IS NULL"), numbered.filter("child_no IS NOT NULL")
    last = F.max("chunk_index").over(Window.partitionBy(document))
    linked = children.withColumn("prev_index", F.when(F.col("chunk_index") > 0, F.col("chunk_index") - 1)).withColumn("next_index", F.when(F.col("chunk_index") < last, F.col("chunk_index") + 1))
    shared = [*by, "parent_index"]
    rest = ["text", "page", "page_end", "has_table", "tokens"]
    return parents.select(*shared, *rest), linked.select(*shared, "chunk_index", *rest, "prev_index", "next_index")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def breadcrumb(title: Column, section: Column) -> Column:
    """What stands before a child's text where it is embedded: its title and section, without repeats."""
    return text.breadcrumb(F.array(F.coalesce(title, F.lit("")), F.coalesce(section, F.lit(""))))
