"""Token counts by byte-pair merging with a heap and a linked list, without making any ids.

A text is cut into pre-tokens by the tokenizer's own splitter, so that both hold the same view of
Unicode. The byte letters of a pre-token are its first symbols; they stand in a linked list, and
a heap holds the adjacent pairs that the merge table knows. The pair of lowest rank is popped
again and again, leftmost first, its two symbols become one, and the two new pairs beside it are
pushed; entries whose pair has changed since are passed over. Each merge makes the list shorter by
one, so the count is the number of first symbols less the merges. A pre-token of n symbols
takes O(n log n) steps, however long it is. Counts of short pre-tokens are remembered by each
worker, up to a fixed number of them.

Strings of special tokens inside a text are one token each, as the library has it by default.

Defined cases: a null text counts as empty, and an empty text has no bytes and no tokens; a row
gives a row, repeated ones too; null ids stay null; long texts are taken in segments that end
where a pre-token ends in any case, so what is held at once is a segment (and a pre-token that is
longer than that whole); other columns, whatever their names, aren't read; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

#: Tokens beyond which a document is marked.
LIMIT = 512
#: Characters looked at in one go.
SEGMENT = 1 << 20
#: Pre-tokens whose counts a worker remembers, and the longest of them.
REMEMBERED, SHORT = 1 << 20, 48
#: Between a letter that every version of Unicode has as one and an ASCII sign that is none, a pre-token ends.
_END = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿа-яА-Яぁ-んァ-ヶ一-龥가-힣])(?=[\t\n\r -@\[-`{-~])")


def merge_count(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the pairs of ``ranks`` make of these symbols, lowest rank first, leftmost of equal ones."""
    n = len(symbols)
    at = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], k) for k in range(n - 1) if (pair := (at[k], at[k + 1])) in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, k = heapq.heappop(heap)
        right = after[k]
        if right >= n or not at[k] or ranks.get((at[k], at[right])) != rank:
            continue  # one of the two has become part of another symbol
        merges += 1
        at[k] += at[right]
        at[right] = ""
        following = after[k] = after[right]
        if following < n:
            before[following] = k
            if (pair := (at[k], at[following])) in ranks:
                heapq.heappush(heap, (ranks[pair], k))
        previous = before[k]
        if previous >= 0 and (pair := (at[previous], at[k])) in ranks:
            heapq.heappush(heap, (ranks[pair], previous))
    return merges


class _Counts(dict):
    """Tokens of pre-tokens by their byte letters; short ones are remembered."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks

    def __missing__(self, letters: str) -> int:
        n = len(letters) - merge_count(letters, self.ranks)
        if len(letters) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[letters] = n
        return n


class Counter:
    """Counts tokens of texts by the byte-level vocabulary in the file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        splitter = spec.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level vocabulary of merges")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take the text beside them")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"])
        self.counts = _Counts({tuple(pair): k for k, pair in enumerate(pairs)})
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if added else None

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        total, low = 0, 0
        while low < len(text):
            end = _END.search(text, low + SEGMENT)
            high = end.start() if end else len(text)
            total += sum(self.counts[letters] for letters, _ in self.split(text[low:high]))
            low = high
        return total

    def tokens(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        total, low = 0, 0
        for found in self.special.finditer(text):
            total += self.plain(text[low : found.start()]) + 1
            low = found.end()
        return total + self.plain(text[low:] if low else text)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _counted(path: str):
    def run(batches):
        tokens = counter(path).tokens
        for whole in batches:
            for batch in slices(whole, "_text"):
                n = pa.array([tokens(text) for text in batch.column("_text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), n], names=["_id", "_bytes", "_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.octet_length(text).cast("long").alias("_bytes"), text.alias("_text"))
    out = rows.mapInArrow(_counted(tokenizer), f"_id {docs.schema[id_col].dataType.simpleString()}, _bytes long, _tokens long")
    return out.select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))
