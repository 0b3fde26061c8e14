"""The best ``k`` rows of many questions at once: each task holds the questions and ranks its rows block by block.

Rows come in the order of their keys, so of equal values the earlier row wins, and a question that
has ``k`` rows takes only what is better than the worst of them. Values are the exact ones, summed
in the order of the columns; products of whole blocks only find which rows are worth that.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Questions and rows that are held against each other at once.
ASKING, ROWS = 256, 1024
#: Values are rounded to six digits, as ``F.round`` does.
STEP, DIGITS = 1e-6, Decimal("0.000001")
#: In place of a value that is not a number, and of a missing one; both come last.
NAN, NONE = 1e200, 1e300


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, half up by the decimal digits of the number."""
    scaled = x / STEP
    out = np.where(np.abs(x) < 1e9, np.floor(scaled + 0.5) / 1e6, x)
    close = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) & (np.abs(x) < 1e9))
    out[close] = [float(Decimal(repr(float(v))).quantize(DIGITS, ROUND_HALF_UP)) for v in x[close]]
    return out + 0.0


class Best:
    """The ``k`` least values of each of ``n`` questions."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.bound, self.new = n, k, np.full(n, np.inf), 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]

    def add(self, q: np.ndarray, value: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((q, value, at))
        self.new += len(q)
        if self.new > 2 * self.k * self.n or (self.new and np.isinf(self.bound).any()):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, value, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((at, value, q))
        q, value, at = q[order], value[order], at[order]
        nth = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q]
        last = nth == self.k - 1
        self.bound[q[last]] = value[last]
        kept = nth < self.k
        self.parts, self.new = [(q[kept], value[kept], at[kept])], 0
        return self.parts[0]


def best(blocks, n: int, k: int, near, exact):
    """(question's number, value, key) in arrow arrays: the ``k`` rows of each question with the least value.

    ``blocks``: (keys, block) in the order of keys; ``near(low, high, block)``: about the values of
    these questions and all rows of a block, infinite for pairs that don't count, and how far off they may be; ``exact(low, q, r,
    near, block)``: the rounded values of some of them.
    """
    found = [(low, Best(min(ASKING, n - low), k)) for low in range(0, n, ASKING)]
    names, seen = [], 0
    for keys, block in blocks:
        names.append(keys)
        for low, part in found:
            about, noise = near(low, low + part.n, block)
            most = part.bound - 0.5 * STEP
            if about.shape[1] > k and np.isinf(most).any():
                most = np.minimum(most, np.partition(about, k - 1, axis=1)[:, k - 1] + STEP)
            slack = noise + 1e-9 + 1e-12 * np.abs(np.where(np.isinf(most), 0, most))
            q, r = np.nonzero((about <= (most + slack)[:, None]) & (about < np.inf))
            if len(q):
                value = exact(low, q, r, about[q, r], block)
                good = value < part.bound[q]
                part.add(q[good], value[good], seen + r[good])
        seen += len(keys)
    if not names:
        return
    keys = pa.chunked_array(names)
    for low, part in found:
        q, value, at = part.settle()
        if len(q):
            yield low + q, value, keys.take(pa.array(at)).combine_chunks()


def dealt(rows: DataFrame, key: str, by: bool = False) -> DataFrame:
    """``rows`` over the cores at hand, by ``key`` if its rows belong together, in the order of keys."""
    parts = max(2, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    spread = rows.repartition(parts, key) if by else rows.repartition(parts)
    return spread.sortWithinPartitions(key)


def vectors_in(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: which rows of ``lists`` are vectors of it, their numbers, and whether none is missing."""
    at = np.asarray(lists.offsets)
    values = lists.values.slice(at[0], at[-1] - at[0]).cast(pa.float64())
    at = at - at[0]
    there = np.asarray(values.is_valid())
    flat = values.to_numpy(zero_copy_only=False)
    sizes = np.where(np.asarray(lists.is_valid()), np.diff(at), -1)
    out = {}
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        cells = at[:-1][rows][:, None] + np.arange(d)
        out[int(d)] = rows, flat[cells], there[cells].all(axis=1)
    return out


def inner(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list starts and ends among the items of all, and these items."""
    at = np.asarray(lists.offsets)
    return at - at[0], lists.values.slice(at[0], at[-1] - at[0])


def lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * x[:, d]
    return np.sqrt(total)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed one number after another as the columns do."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def pieces(batches, key: str):
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part.column(key), part


def probing(asked: pa.Array, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``asked`` probe a cell: where each cell's start, and their numbers in order. Each probes the cells of its nearest centres.

    A vector without a length, or not as long as the centres, is near to none; it probes the first cells.
    """
    near = np.tile(np.arange(min(probes, len(centres))), (len(asked), 1))
    size = lengths(centres)
    for d, (rows, x, ok) in vectors_in(asked).items():
        for low in range(0, len(rows) if d == centres.shape[1] else 0, ASKING):
            some, y = rows[low : low + ASKING], x[low : low + ASKING]
            with np.errstate(all="ignore"):
                away = 1 - (y @ centres.T) / (lengths(y)[:, None] * size)
            away[~(ok[low : low + ASKING, None] & np.isfinite(away))] = np.inf
            near[some] = np.argsort(away, axis=1, kind="stable")[:, : near.shape[1]]
    order = np.argsort(near, axis=None, kind="stable")
    return np.searchsorted(near.reshape(-1)[order], np.arange(len(centres) + 1)), order // max(1, near.shape[1])


def by_cosine(asked: pa.Array, key: str, k: int, batches, probed: tuple[np.ndarray, np.ndarray] | None = None):
    """The nearest of ``_v`` to each vector of ``asked``, as ``numbers.cosine_distance`` measures it.

    ``probed``, as ``probing`` gives it: a row is measured only against those that probe its ``cell``.
    """
    n = len(asked)
    questions = {d: (rows[ok], x[ok], lengths(x[ok])) for d, (rows, x, ok) in vectors_in(asked).items()}
    place, kind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d, (rows, _, _) in questions.items():
        place[rows], kind[rows] = np.arange(len(rows)), d

    def blocks():
        for keys, part in pieces(batches, key):
            block, size, number = {}, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for d, (rows, x, ok) in vectors_in(part.column("_v")).items():
                rows, x = rows[ok], x[ok]
                size[rows], number[rows] = d, np.arange(len(rows))
                cells = None if probed is None else by_cell(np.asarray(part.column("cell"))[rows])
                block[d] = rows, x, lengths(x), cells
            yield keys, (block, size, number)

    def by_cell(cell):
        """Each cell with the places of its rows."""
        order = np.argsort(cell, kind="stable")
        names, at = np.unique(cell[order], return_index=True)
        return list(zip(names.tolist(), np.split(order, at[1:]), strict=True)) if len(names) else []

    def distances(y, ny, x, nx):
        part = y @ x.T
        part /= ny[:, None]
        part /= nx
        np.subtract(1, part, out=part)
        none = np.outer(ny == 0, nx > -1) | (nx == 0)
        part[np.isnan(part)] = NAN
        part[none] = np.inf
        return part

    def near(low, high, whole):
        block, size, _ = whole
        out = np.full((high - low, len(size)), np.inf)
        with np.errstate(all="ignore"):
            for d, (rows, x, nx, cells) in block.items():
                if d in questions:
                    asking, y, ny = questions[d]
                    a, b = np.searchsorted(asking, [low, high])
                    if cells is None:
                        part = distances(y[a:b], ny[a:b], x, nx)
                        if part.shape == out.shape:
                            out = part
                        else:
                            out[np.ix_(asking[a:b] - low, rows)] = part
                        continue
                    starts, numbers = probed
                    for cell, j in cells:
                        those = numbers[starts[cell] : starts[cell + 1]]
                        those = those[slice(*np.searchsorted(those, [low, high]))]
                        i = place[those[kind[those] == d]]
                        if len(i):
                            out[np.ix_(asking[i] - low, rows[j])] = distances(y[i], ny[i], x[j], nx[j])
        return out, 0.0

    def exact(low, q, r, about, whole):
        block, size, number = whole
        out = np.empty(len(q))
        with np.errstate(all="ignore"):
            for d in np.unique(size[r]):
                some = np.flatnonzero(size[r] == d)
                _, x, nx, _ = block[d]
                _, y, ny = questions[d]
                i, j = number[r[some]], place[low + q[some]]
                value = 1 - dots(x[i], y[j]) / (nx[i] * ny[j])
                out[some] = np.where(np.isfinite(value), rounded(np.where(np.isfinite(value), value, 0)), NAN)
        return out

    return best(blocks(), n, k, near, exact)


def by_parts(asked: pa.Array, key: str, k: int, batches):
    """The best of ``_p`` for each list of vectors of ``asked``, as ``numbers.max_sim`` scores it; values are less than 0 for more."""
    n, starts, vectors = (len(asked), *inner(asked))
    questions = vectors_in(vectors)
    largest = max((np.abs(x[ok]).max(initial=0.0) for _, x, ok in questions.values()), default=0.0)

    def blocks():
        for keys, part in pieces(batches, key):
            at, vectors = inner(part.column("_p"))
            yield keys, (at, vectors_in(vectors), len(keys))

    def dot(a, b, block):
        """About the products of the questions' vectors a .. b and all vectors of a block; least where there is none."""
        at, vectors, _ = block
        out = np.full((b - a, int(at[-1])), -np.inf)
        for d, (rows, x, ok) in vectors.items():
            if d in questions:
                asking, y, good = questions[d]
                i, j = np.searchsorted(asking, [a, b])
                part = y[i:j] @ x.T
                part[:, ~ok] = -np.inf
                part[~good[i:j]] = -np.inf
                part[np.isnan(part)] = -np.inf
                if part.shape == out.shape:
                    return part
                out[np.ix_(asking[i:j] - a, rows)] = part
        return out

    def sums(at, values, axis, take):
        """``take`` of the values between each two of ``at``; nothing where there are none."""
        some = np.flatnonzero(np.diff(at) > 0)
        shape = list(values.shape)
        shape[axis] = len(at) - 1
        out = np.full(shape, 0.0 if take is np.add else -np.inf)
        if len(some):
            got = take.reduceat(values, at[some], axis=axis)
            if axis:
                out[:, some] = got
            else:
                out[some] = got
        return out

    def near(low, high, block):
        at = block[0]
        a, b = starts[low], starts[high]
        of_item = sums(at, dot(a, b, block), 1, np.maximum) if at[-1] > at[0] else np.full((b - a, block[2]), -np.inf)
        score = sums(starts[low : high + 1] - a, of_item, 0, np.add)
        longest = max((np.abs(x[ok]).max(initial=0.0) * d for d, (_, x, ok) in block[1].items()), default=0.0)
        return np.where(np.isfinite(score), -score, NONE), 1e-14 * (b - a) * longest * largest

    def index(vectors, length):
        """For each vector its length, 0 where it counts for nothing, and its place among those of that length."""
        size, number = np.zeros(length, np.int64), np.zeros(length, np.int64)
        for d, (rows, _, ok) in vectors.items():
            size[rows], number[rows] = np.where(ok, d, 0), np.arange(len(rows))
        return size, number

    asked_size, asked_number = index(questions, int(starts[-1]))

    def exact(low, q, r, about, block):
        at, vectors, _ = block
        size, number = index(vectors, int(at[-1]))
        total, none = np.zeros(len(q)), about >= NONE
        for j in range(int(np.diff(starts)[low + q].max(initial=0))):
            left = starts[low + q] + j
            some = np.flatnonzero(~none & (left < starts[low + q + 1]))
            top = np.full(len(some), -np.inf)
            for i in range(int(np.diff(at)[r[some]].max(initial=0))):
                right = at[r[some]] + i
                both = np.flatnonzero(right < at[r[some] + 1])
                u, v = left[some[both]], right[both]
                for d in np.unique(asked_size[u]):
                    same = (asked_size[u] == d) & (size[v] == d) & (d > 0)
                    if same.any():
                        value = dots(questions[d][1][asked_number[u[same]]], vectors[d][1][number[v[same]]])
                        top[both[same]] = np.fmax(top[both[same]], value)
            total[some] += top
        return np.where(none, NONE, -rounded(np.where(none | ~np.isfinite(total), 0, total)))

    return best(blocks(), n, k, near, exact)


#: Postings that make a block at least; terms of so small a share of a block's rows are added one posting at a time.
POSTINGS, RARE = 100_000, 1 / 32


def by_terms(asked: tuple[np.ndarray, np.ndarray, np.ndarray], key: str, k: int, batches):
    """The best by the sum of ``_gain`` over a question's terms, each as often as it asks; values are less than 0 for more.

    ``asked``: where each question's terms start, the terms, how often. ``batches``: key, _t, _gain, in the order of keys.
    """
    starts, terms, often = asked

    def whole():
        """Batches joined to blocks that hold all postings of their rows."""
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= POSTINGS:
                rows = pa.Table.from_batches(kept).combine_chunks()
                first = runs(rows.column(key))
                if first[-1]:
                    yield rows.slice(0, first[-1]), first[:-1]
                    kept = rows.slice(first[-1]).to_batches()
                    size = sum(b.num_rows for b in kept)
        if size:
            rows = pa.Table.from_batches(kept).combine_chunks()
            yield rows, runs(rows.column(key))

    def runs(keys):
        """Where each key starts."""
        x = keys.combine_chunks()
        differs = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), False)
        absent = np.asarray(x.is_null())
        return np.concatenate([[0], 1 + np.flatnonzero(np.asarray(differs) | (absent[1:] != absent[:-1]))])

    def built():
        for rows, first in whole():
            m = len(first)
            row = np.repeat(np.arange(m), np.diff(np.append(first, rows.num_rows)))
            term, gain = np.asarray(rows.column("_t")).astype(np.int64), np.asarray(rows.column("_gain"))
            order = np.argsort(term, kind="stable")
            term, gain, row = term[order], gain[order], row[order]
            there, at = np.unique(term, return_index=True)
            ends = np.append(at, len(term))
            count = np.diff(ends)
            dense = np.flatnonzero(count > RARE * m)
            table = np.zeros((len(dense), m))
            line = np.full(len(there), -1)
            line[dense] = np.arange(len(dense))
            of = np.repeat(line, count)
            np.add.at(table, (of[of >= 0], row[of >= 0]), gain[of >= 0])
            place = np.minimum(np.searchsorted(there, terms), max(0, len(there) - 1))
            known = there[place] == terms
            lines, rare = np.where(known, line[place], -1), np.where(known & (line[place] < 0), place, -1)
            yield rows.column(key).take(pa.array(first)).combine_chunks(), (m, table, lines, rare, ends, row, gain)

    def near(low, high, block):
        m, table, lines, rare, ends, row, gain = block
        out = np.zeros((high - low, m))
        a, b = starts[low], starts[high]
        asker = np.repeat(np.arange(high - low), np.diff(starts[low : high + 1]))
        for q, line, times in zip(asker[lines[a:b] >= 0].tolist(), lines[a:b][lines[a:b] >= 0].tolist(), often[a:b][lines[a:b] >= 0].tolist(), strict=True):
            if times == 1:
                out[q] += table[line]
            else:
                out[q] += times * table[line]
        some = np.flatnonzero(rare[a:b] >= 0)
        if len(some):
            place = rare[a:b][some]
            size = ends[place + 1] - ends[place]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[place], size)
            np.add.at(out.reshape(-1), np.repeat(asker[some], size) * m + row[step], np.repeat(often[a:b][some], size) * gain[step])
        np.negative(out, out=out)
        out[out > -0.25 * STEP] = np.inf
        return out, 0.0

    def exact(low, q, r, about, block):
        value = rounded(about)
        return np.where(value < 0, value, np.inf)

    return best(built(), len(starts) - 1, k, near, exact)
