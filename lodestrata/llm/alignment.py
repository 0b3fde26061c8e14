"""Alignment of two tokenizers: groups of tokens between the byte offsets where both end a token.

Each text is encoded by both vocabularies. Every byte of the space and text gets a label: no token
ends there, one of A, one of B, or one of both. A regular expression reads this label string in
spans that close with a both-label, and the labels of a span say how many tokens of A and of B
make up its group. Within a group every token of A is linked with every token of B; equal links of
a group are kept with how often they occur, so a group of n and m tokens takes as many rows as it
has distinct pairs.

How many documents hold a pair of ids is counted over the corpus in two steps. A block of some MB
of texts keeps its distinct pairs once, with how many of its documents hold each; these counts are
added up by pair. For the way back each block asks once for each of its pairs, not once for each
document, so what moves grows with the distinct pairs of the blocks, and a pair that stands
everywhere moves once a block. Pairs that very many blocks ask for are answered by a broadcast
of a checked size, the others by a join that shuffles. Blocks are written to shared storage
before they are counted, a short row for each pair and for each document, which names its pairs by
place; texts and tokens never move. The answers to a block's pairs and its documents meet in one
sorted stream, answers first, so no row, group or list of Spark's holds a whole block.

Defined cases: null and empty texts, and texts whose tokens don't give back the space and text byte
for byte in both vocabularies, have no tokens: zeros and an empty digest. A row gives a row, and
repeated rows count as documents of their own; null ids stay null; a text is never cut, so a very long one is a block by
itself; other columns, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialise, slices, text_or_empty
from .packing import FAST_UP_TO, _byte_letters, encoders

#: Bytes of text in a block, and of those encoded in one go.
BLOCK, PART = 1 << 22, 1 << 18
#: Rows of pairs handed on in one go.
ROWS = 10_000
#: Bits of an id of B in a pair's number.
SHIFT = 20
NONE, A_END, B_END, BOTH = (ord(c) for c in ".ab|")
_SPAN = re.compile(rb"[^|]*\|")


class Aligner:
    """Both vocabularies: A is byte-level, B has pieces with byte fallback (``sentencepiece``).

    A's ids come from the faster of two libraries with the same vocabulary and merges (see
    ``packing``), from ``tokenizers`` where a text is too long for that one; tests hold both
    against each other.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.fast = encoders(path_a)[0]
        self.path_a = path_a
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        words = {k: bytes(letters[c] for c in word) for word, k in spec["model"]["vocab"].items()}
        self.bytes_a = [words.get(k, b"") for k in range(max(words) + 1)]
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        # an id as it is written in a group: with what follows it there
        self.inner, self.last_a, self.last_b = (np.array([f"{k}{c}" for k in range(max(len(self.bytes_a), len(self.bytes_b)))], object) for c in ",|;")

    @functools.cached_property
    def exact(self):
        """The slower library, which few workers need."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path_a)
        out.encode_special_tokens = True  # their strings in a text are ordinary text
        return out

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> np.ndarray:
        if len(text) < FAST_UP_TO:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except (ValueError, OverflowError):  # no stack left, or a character that it can't take
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B for each text; None where there is no text or the tokens don't give back space and text."""
        there = [k for k, text in enumerate(texts) if text]
        out: list = [None] * len(texts)
        for k, b in zip(there, self.b.encode([texts[k] for k in there], num_threads=1), strict=True):
            whole = " " + texts[k]
            a, given = self.ids_a(whole), whole.encode()
            # tokens of A are stretches of the text itself, so their bytes are the text's if they are as many
            if b"".join(map(self.bytes_b.__getitem__, b)) == given and int(self.size_a[a].sum()) == len(given):
                out[k] = a, np.array(b, np.int64)
        return out

    def written(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> str:
        """The groups as text: ids of A, then of B, comma-joined; ``sizes``: tokens of A and of B in each."""
        ends_a, ends_b = sizes.cumsum(0).T
        words_a, words_b = self.inner[a], self.inner[b]
        words_a[ends_a - 1], words_b[ends_b - 1] = self.last_a[a[ends_a - 1]], self.last_b[b[ends_b - 1]]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.repeat(ends_b - sizes[:, 1], sizes[:, 0])] = words_a
        out[np.arange(len(b)) + np.repeat(ends_a, sizes[:, 1])] = words_b
        return "".join(out.tolist())[:-1]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """A label for each byte; ``ends``: offsets after the last byte of each token, in order."""
    out = np.full(int(ends_a[-1]), NONE, np.uint8)
    out[ends_a - 1] = A_END
    at = ends_b - 1
    out[at] = np.where(out[at] == A_END, BOTH, B_END)
    return out.tobytes()


class _Sizes(dict):
    """Tokens of A (times 2^32) and of B that end in a span of labels; spans of the common shapes are counted once."""

    def __missing__(self, span: bytes) -> int:
        out = (span.count(b"a") + 1 << 32) + span.count(b"b") + 1
        if len(span) <= 32 and len(self) < 1 << 16:
            self[span] = out
        return out


_SIZES = _Sizes()


def group_sizes(label: bytes) -> np.ndarray:
    """Tokens of A and of B in each group: the labels of the spans up to each both-label."""
    spans = _SPAN.findall(label)
    both = np.fromiter(map(_SIZES.__getitem__, spans), np.int64, len(spans))
    return np.stack((both >> 32, both & 0xFFFFFFFF), 1)


def _expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often each occurs, in order of group."""
    key = np.sort((group << SHIFT) + ids, kind="stable")  # nearly in order as it is
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    return key >> SHIFT, key & ((1 << SHIFT) - 1), n


def links(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair number and how often the pair is linked there; both lists are in order of group and hold the same groups."""
    ga, a, na = _distinct(group_a, ids_a)
    gb, b, nb = _distinct(group_b, ids_b)
    size_b = np.bincount(gb, minlength=int(gb[-1]) + 1)
    begin_b = np.cumsum(size_b) - size_b
    partners = size_b[ga]
    left, right = np.repeat(np.arange(len(ga)), partners), _expand(begin_b[ga], partners)
    return ga[left], (a[left] << SHIFT) + b[right], na[left] * nb[right]


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of ``n`` of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first)


def _part(both: Aligner, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """The figures of each text, how many distinct pairs it has, and these pairs with how often they are linked, text by text."""
    figures, ga, ia, gb, ib, owner, opened = [], [], [], [], [], [], 0
    for k, found in enumerate(both.encode(texts)):
        if found is None:
            figures.append((0, 0, 0, 0, ""))
            continue
        one, two = found
        of = group_sizes(labels(np.cumsum(both.size_a[one]), np.cumsum(both.size_b[two])))
        numbers = np.arange(opened, opened + len(of))
        ga.append(np.repeat(numbers, of[:, 0]))
        gb.append(np.repeat(numbers, of[:, 1]))
        ia.append(one)
        ib.append(two)
        owner.append(np.full(len(of), k))
        opened += len(of)
        figures.append((len(one), len(two), len(of), int((of[:, 0] * of[:, 1]).sum()), hashlib.sha256(both.written(one, two, of).encode()).hexdigest()))
    if not opened:
        return figures, np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group, pair, n = links(*map(np.concatenate, (ga, ia, gb, ib)))
    key, n = _added((np.concatenate(owner)[group] << 2 * SHIFT) + pair, n)  # a part's documents are fewer than 2^23
    return figures, np.bincount(key >> 2 * SHIFT, minlength=len(texts)), key & ((1 << 2 * SHIFT) - 1), n


def _place_type(pairs: int) -> str:
    """Of the places of so many pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


#: What a document has before its pairs are counted, for Spark and for Arrow.
FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_FIGURES = [pa.field(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [pa.field("groups_sha256", pa.string())]


def _aligned(path_a: str, path_b: str):
    """Rows of texts to blocks: a row for each distinct pair, with how many documents hold it, then one for each document."""

    def rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        both = aligner(path_a, path_b)
        for whole in batches:
            schema = pa.schema([("_block", pa.int64()), ("_place", pa.int64()), ("_pair", pa.int64()), ("_held", pa.int64()), ("_id", whole.column("_id").type), *_FIGURES, ("at", pa.binary()), ("times", pa.binary())])
            for batch in slices(whole, "_text", BLOCK):
                figures, sizes, linked, often = [], [], [], []
                for part in slices(batch, "_text", PART):
                    of, size, pair, n = _part(both, part.column("_text").to_pylist())
                    figures += of
                    sizes.append(size)
                    linked.append(pair)
                    often.append(n.astype(np.min_scalar_type(int(n.max(initial=0)))))
                pairs, at, held = np.unique(np.concatenate(linked), return_inverse=True, return_counts=True)
                at, cut = at.astype(_place_type(len(pairs))), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
                often = [n for size, of in zip(sizes, often, strict=True) for n in np.split(of, np.cumsum(size)[:-1])]
                block = batch.column("_key")[0].as_py()
                for low in range(0, len(pairs), ROWS):
                    some = slice(low, low + ROWS)
                    n = len(pairs[some])
                    yield rows(schema, n, _block=pa.array(np.full(n, block)), _place=pa.array(np.arange(low, low + n)), _pair=pa.array(pairs[some]), _held=pa.array(held[some]))
                columns = {f.name: pa.array(column, f.type) for f, column in zip(_FIGURES, zip(*figures, strict=True), strict=True)}
                places = pa.array([at[low:high].tobytes() for low, high in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                times = pa.array([n.astype(n.dtype.newbyteorder("<")).tobytes() for n in often], pa.binary())
                yield rows(schema, batch.num_rows, _block=pa.array(np.full(batch.num_rows, block)), _id=batch.column("_id"), at=places, times=times, **columns)

    return run


def _summed(batches):
    """Answers to the pairs of a block in order of place, then its documents, block after block: a row for each document."""
    block, told, count, best = None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        of, place = batch.column("_block").to_numpy(), batch.column("_place")
        document = place.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (document[1:] != document[:-1]))))
        for low, high in zip(starts, np.append(starts[1:], len(of)), strict=True):
            rows = batch.slice(low, high - low)
            if of[low] != block:
                block, told, count = of[low], [], None
            if not document[low]:
                told.append((rows.column("_count").to_numpy(), rows.column("_best").to_numpy(zero_copy_only=False)))
                continue
            if count is None:
                count, best = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64), np.zeros(0, bool))
                told, kind = [], _place_type(len(count))
            n_best, total = [], []
            for at, times in zip(rows.column("at").to_pylist(), rows.column("times").to_pylist(), strict=True):
                at = np.frombuffer(at, kind)
                times = np.frombuffer(times, f"<u{len(times) // max(1, len(at)) or 1}").astype(np.int64)
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * count[at]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*map(rows.column, ("_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), rows.column("groups_sha256")],
                names=["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents in blocks, written to shared storage: rows with a ``_place`` are pairs, the others documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"), F.monotonically_increasing_id().alias("_key"))
    schema = f"_block long, _place long, _pair long, _held long, _id {kind}, {FIGURES}, at binary, times binary"
    return materialise(rows.mapInArrow(_aligned(path_a, path_b), schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Every linked pair of ids: id_a, id_b, in how many documents it stands, and whether no other of its id_a stands in more."""
    held = aligned.filter("_place IS NOT NULL")
    counts = held.groupBy("_pair").agg(F.sum("_held").alias("n_docs"), F.count("*").alias("_asked")).withColumn("id_a", F.shiftrightunsigned("_pair", SHIFT))
    counts = materialise(counts, "pairs")
    most = counts.groupBy("id_a").agg(F.max("n_docs").alias("_most"))  # as many rows as A has ids
    return counts.join(most, "id_a").select("_pair", "id_a", F.col("_pair").bitwiseAND((1 << SHIFT) - 1).alias("id_b"), "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"), "_asked")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    aligned = blocks(docs, path_a, path_b, id_col, text_col)
    counts = pair_counts(aligned).withColumnRenamed("_pair", "_of")
    asked = aligned.filter("_place IS NOT NULL").select("_block", "_place", "_pair")
    told = looked_up(asked, "_pair", counts.select("_of", F.col("n_docs").alias("_count"), F.col("best").alias("_best"), "_asked"), "_of", "_asked").drop("_pair")
    both = told.unionByName(aligned.filter("_place IS NULL").drop("_pair", "_held"), allowMissingColumns=True)
    stream = both.repartition("_block").sortWithinPartitions("_block", F.col("_place").asc_nulls_last())
    out = stream.mapInArrow(_summed, f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("_id", id_col)
