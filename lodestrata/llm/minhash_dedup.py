"""Near-duplicate detection with ProbMinHash.

A text is the multiset of its five-word shingles, the weight of a shingle being how often it
occurs. Two texts are linked if their weighted Jaccard similarity

    J_W(A, B) = sum over x of min(A_x, B_x) / sum over x of max(A_x, B_x)

is 0.8 or more; for texts that repeat no shingle this is the ordinary Jaccard similarity.

Signatures estimate the probability Jaccard similarity

    J_P(A, B) = sum over shared x of 1 / sum over y of max(A_y / A_x, B_y / B_x)

which is at least J_W, so no link is missed for the difference. Every shingle is a Poisson
process of arrivals whose rate is its weight; each arrival falls into one of M components, and a
component keeps the shingle that arrived first. Equal components then have probability J_P.
Processing stops early: a shingle is followed only while its next arrival is before the latest
of the components' first arrivals. Bands of components give buckets; a pair of similarity 0.8
shares no bucket with probability (1 - 0.8^R)^B, 7e-6 here.

Within buckets members aren't paired off. The leader L of a bucket is the member that meets most
others in all its buckets: of a text and its edited copies, the text, so that little stands outside
it. Each member is verified against L on exact shingles: as many checks as members. Take a member x
that isn't linked to L and any member y linked to x, and say x and y share nothing outside L.
Then |x and L| >= |x and y|, and if |L| <= |y|, J_W(x, L) >= J_W(x, y) >= 0.8, a contradiction.
Hence x and y share a shingle outside L, and more exactly |x and y| - |x and L| of them, where
|x and y| must be at least 0.8 / 1.8 (|x| + |y|). Put the shingles outside L in any order that is
the same for all members: x and y then share one of the first |x outside L| - s + 1 of x's and
one of as many of y's, the same one, s being the least number that x (or y) needs. The bucket
splits into smaller buckets, one for each such shingle (L is in none of them), that are treated
alike; shingles that stand in one class only make none. What this leaves are pairs of an x that
isn't linked to L and a y smaller than L of which neither needs a shingle outside L, given the
least size among the members. Such x and y form one more bucket, whose leader is its smallest
text, and no member is smaller than that. L need not be in the bucket: any text will do that has
met them all. The buckets of one family overlap, so large buckets are split by the first leader of
those that their members are in (the head), and a member is split about once, not once for each
leader that it has. The order puts shingles that were not met twice among ``SAMPLE`` members of a
large bucket first and the most common last: it only decides how small the new buckets get, not
what is found.

Buckets whose members are all of one class are done at any point, buckets with the same members
count once, and small buckets are settled pair by pair, where texts too unlike in size aren't
tried: up to ``SMALL`` members at first, ``GROWTH`` times as many after each split, so there are no
more rounds than the logarithm of the largest bucket. A bucket of thousands of near copies costs
about as many checks as it has members once they are linked, and no pair that shares a bucket
and might join two classes is left untested. The pairs of the last rounds can be many only where
very many texts are a little less than 0.8 alike and share shingles that are not the leaders'.

Links are made on words, not on hashes: a pair that is similar by 64-bit hashes of its shingles
is held against each other once more with its words numbered.

Texts move as follows: one shuffle deals the texts that share a bucket with another by node into
a bucketed table. Members are joined to it without moving it; a pair's text then meets its
leader's.

Defined cases: a null text counts as empty; equal texts (empty ones too) are one class; a text of
1 to 4 words has one shingle; texts without words are linked to equal texts only; very long texts
are read whole, some megabytes at a time until their shingles are counted; columns of any other
name are carried along and never read; a null id is
allowed and is smaller than any other; rows that agree in id and text are one class; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, beside, buckets_for, digest, drop_rows, is_empty, materialise, mix64, shingles, slices, small, text_bytes, text_or_empty
from .components import merged

WORDS, SIMILAR = 5, 0.8
ROWS, BANDS = 5, 30
#: Members of a bucket that may be settled pair by pair at first, and by how much that grows after each split.
SMALL, GROWTH = 16, 8
#: From so many members on, shingles that are common among a sample of as many come last.
SAMPLE = 32
#: Members of a leader that are compared in one task.
SHARED = 256


def prob_minhash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Signatures (rows x m) of the weighted sets given by (row, item, weight); a row without items gets zeros."""
    first = np.full(rows * m, np.inf)
    signature = np.zeros(rows * m, np.uint64)
    time, draw, step = np.zeros(len(item)), item.copy(), np.uint64(0)
    latest = np.full(rows, np.inf)
    while len(item):
        step += np.uint64(1)
        draw = mix64(draw + step)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = time < latest[row]
        row, item, weight, time, draw = row[alive], item[alive], weight[alive], time[alive], draw[alive]
        slot = row * m + (mix64(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        signature[slot[won]] = item[won]
        there = np.unique(row)
        latest[there] = first.reshape(rows, m)[there].max(axis=1)
    return signature.reshape(rows, m)


def signed(batches):
    """Digest, id, size and band keys of each row (no keys for a text without words)."""
    for whole in batches:
        for batch in slices(whole, "_text"):
            data, at = text_bytes(batch.column("_text"))
            row, item, count = shingles(data, at, WORDS)
            n = batch.num_rows
            sign = prob_minhash(row, item, count.astype(np.float64), n, ROWS * BANDS)
            spread = mix64(sign.reshape(n, BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64))
            keys = mix64(spread.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            some = np.zeros(n, bool)
            some[row] = True
            ends = np.cumsum(np.where(some, BANDS, 0))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
            sizes = np.bincount(row, weights=count, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_digest"), pa.array(sizes), pa.array(np.diff(at)), bands], names=["_id", "_digest", "size", "bytes", "bands"])


def _pairs_of(batch):
    """For each row the shingles and counts of both texts."""
    sides = []
    for name in ("text_a", "text_b"):
        row, item, count = shingles(*text_bytes(batch.column(name)), WORDS)
        sides.append((item, count, np.searchsorted(row, np.arange(batch.num_rows + 1))))
    (xa, ca, at), (xb, cb, bt) = sides
    for k in range(batch.num_rows):
        yield xa[at[k] : at[k + 1]], ca[at[k] : at[k + 1]], xb[bt[k] : bt[k + 1]], cb[bt[k] : bt[k + 1]]


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_W of two multisets given by sorted distinct items and their weights."""
    least, most = sorted((int(wa.sum()), int(wb.sum())))
    if not least:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(wa[ia], wb[ib]).sum())
    return shared / (least + most - shared)


def exact_jaccard(text_a: bytes, text_b: bytes) -> float:
    """J_W of two texts on their words themselves: words are numbered, shingles then ranked step by step."""
    number: dict[bytes, int] = {}
    sides = [np.fromiter((number.setdefault(w, len(number)) for w in text.split()), np.int64) for text in (text_a, text_b)]
    size = [min(WORDS, len(x)) for x in sides]
    if not min(size) or size[0] != size[1]:
        return 0.0
    code = np.concatenate([x[: len(x) - size[0] + 1] for x in sides])
    for k in range(1, size[0]):
        following = np.concatenate([x[k : len(x) - size[0] + 1 + k] for x in sides])
        _, code = np.unique(code * len(number) + following, return_inverse=True)
    n = len(sides[0]) - size[0] + 1
    counts = [np.bincount(c, minlength=int(code.max()) + 1) for c in (code[:n], code[n:])]
    shared = int(np.minimum(*counts).sum())
    return shared / (len(code) - shared)


def verified(similar: float):
    """Keeps the pairs (a, b, text_a, text_b) whose texts are similar enough."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text_b"):
                near = [k for k, pair in enumerate(_pairs_of(batch)) if weighted_jaccard(*pair) >= similar - 1e-12]
                good = [k for k in near if exact_jaccard(*(batch.column(c)[k].as_buffer().to_pybytes() for c in ("text_a", "text_b"))) >= similar - 1e-12]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def outside(similar: float, whole: bool = False):
    """For pairs (leader a, member b) the shingles of b that a lacks, or has less often.

    Those come that b shares at least one of with any text that it is linked to, that has ``least``
    shingles or more and that a doesn't settle; ``whole``: all of them. The order is by hash, but
    what is in ``common`` comes last, in the order given there. A null stands for texts smaller
    than a that b may be linked to without any of its shingles, and marks them too.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_b"):
                yield _outside(part, similar, whole)

    return run


def _outside(batch, similar, whole):
    items, open_ = [], np.zeros(batch.num_rows, bool)
    least = None if whole else batch.column("least").to_numpy()
    late = [None] * batch.num_rows if whole else [x.values.to_numpy() if x.is_valid else None for x in batch.column("common")]
    for k, ((a, wa, b, wb), common) in enumerate(zip(_pairs_of(batch), late, strict=True)):
        have = np.zeros(len(b), np.int64)
        _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        have[ib] = wa[ia]
        more = np.maximum(wb - have, 0)
        which = np.repeat(np.arange(len(b)), more)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + have[which]
        item = np.sort(mix64(b[which] + mix64(nth.astype(np.uint64))).view(np.int64))
        if not whole:
            size, leader, shared = int(wb.sum()), int(wa.sum()), int(wb.sum() - more.sum())
            need = int(np.ceil(similar / (1 + similar) * (size + max(least[k], similar * size)) - 1e-9)) - shared
            open_[k] = need <= 0 and (size < leader or shared < similar / (1 + similar) * (size + leader) - 1e-9)
            if common is not None:
                order = np.argsort(common, kind="stable")
                at = np.minimum(np.searchsorted(common, item, sorter=order), len(common) - 1)
                there = common[order[at]] == item
                item = np.concatenate([item[~there], common[np.sort(order[at[there]])]])
            item = item[: max(0, len(item) - max(1, need) + 1)]
        items.append(np.append(item, 0) if open_[k] else item)
    ends = np.cumsum([0, *map(len, items)])
    none = np.zeros(ends[-1], bool)
    none[ends[1:][open_] - 1] = True
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(items) if items else np.zeros(0, np.int64), mask=none))
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), lists], names=["a", "b", "items"])


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


class _Settling:
    """Finds the classes of ``bodies(node, text)``, a table bucketed by node, from buckets of nodes."""

    def __init__(self, bodies: DataFrame, similar: float, scratch: Scratch):
        self.bodies, self.similar, self.scratch = bodies, similar, scratch

    def texts(self, pairs: DataFrame, of_leader: DataFrame | None = None) -> DataFrame:
        """``pairs``, a written table, with text_a and text_b, and what ``of_leader`` has by a.

        The text of b is met where it lies. A leader of more than ``SHARED`` members goes to as
        many tasks as it needs.
        """
        leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARED).cast("int").alias("_parts"))
        hot = self.scratch.table(leaders.filter("_parts > 1").withColumnRenamed("a", "_hot"), "hot")
        parts = pairs.join(small(hot), F.col("a") == F.col("_hot"), "left")
        pieces = parts.withColumn("_piece", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hot", "_parts")
        right = self.bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        left = leaders.hint("shuffle_hash").join(self.bodies, F.col("a") == F.col("node")).select("a", "_parts", F.col("text").alias("text_a"))
        left = left if of_leader is None else left.join(of_leader, "a", "left")
        spread = left.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        return pieces.hint("shuffle_hash").join(right, "b").join(spread, ["a", "_piece"])

    def linked(self, labels: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """``labels`` after what is similar among ``pairs(a, b)`` is joined."""
        table = self.scratch.table(pairs, "pairs")
        links = self.scratch.table(self.texts(table).select("a", "b", "text_a", "text_b").mapInArrow(verified(self.similar), "a long, b long"), "links")
        labels = merged(labels, links, self.scratch)
        self.scratch.drop(table, links)
        return labels

    def different(self, buckets: DataFrame) -> DataFrame:
        """(bucket, node, size, by_size) with one bucket of those that hold the same members, and how many each node meets in all."""
        marks = buckets.groupBy("bucket").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_x"))
        one = self.scratch.table(marks.groupBy("_n", "_s", "_x").agg(F.min("bucket").alias("bucket")).select("bucket", "_n"), "different")
        held = self.scratch.table(buckets.join(one, "bucket"), "held")
        meets = held.groupBy("node").agg(F.sum("_n").alias("meets"))
        out = self.scratch.table(held.drop("_n").join(meets, "node"), "buckets")
        self.scratch.drop(one, held)
        return out

    def led(self, active: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Buckets of several classes, with their leader and its place among leaders."""
        first = F.struct(F.when(F.col("by_size"), 0).otherwise(-F.col("meets")).alias("meets"), "size", "node", "label")
        rows = _labelled(active, labels).groupBy("bucket").agg(F.min(first).alias("l"), F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("n"))
        return self.scratch.table(rows.filter("_low <> _high").select("bucket", F.col("l.node").alias("a"), F.col("l.label").alias("of"), F.struct("l.meets", "l.size", "l.node").alias("_place"), "n"), "leaders")

    def heads(self, large: DataFrame) -> DataFrame:
        """(bucket, head): the first leader of the large buckets that any member of a bucket is in.

        The buckets of a family overlap, and so have few heads, most members only one, where they
        have a leader for each bucket. Buckets led by size keep their own leader, as no member is smaller.
        """
        own = large.filter("NOT by_size").select("bucket", "node", F.col("_place").alias("l"))
        least = own.groupBy("node").agg(F.min("l").alias("l"))
        shared = own.select("bucket", "node").join(least, "node").groupBy("bucket").agg(F.min("l").alias("l")).select("bucket", F.col("l.node").alias("head"))
        return self.scratch.table(shared.union(large.filter("by_size").groupBy("bucket").agg(F.min("a").alias("head"))), "heads")

    def paired(self, few: DataFrame) -> DataFrame:
        """The pairs of different classes within small buckets, each met in the first bucket that both are in."""
        few = few.select("bucket", "node", "size", "label")
        few = self.scratch.table(few.join(few.groupBy("node").agg(F.collect_set("bucket").alias("all")), "node"), "few")
        other = few.select("bucket", F.col("node").alias("b"), F.col("size").alias("_size"), F.col("label").alias("_other"), F.col("all").alias("_all"))
        alike = (F.least("size", "_size") >= self.similar * F.greatest("size", "_size") - 1e-9) & (F.col("label") != F.col("_other")) & (F.col("a") < F.col("b"))
        once = F.expr("array_min(array_intersect(all, _all)) = bucket")
        return few.withColumnRenamed("node", "a").join(other, "bucket").filter(alike & once).select("a", "b")

    def common(self, many: DataFrame) -> DataFrame:
        """For each leader of more than SAMPLE members the shingles that several of a sample of them have outside it, the rarest first."""
        nth = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))
        full = many.groupBy("a").agg(F.count("*").alias("_m")).filter(F.col("_m") > SAMPLE).select("a")
        some = self.scratch.table(many.select("a", "b").withColumn("_k", nth).filter(F.col("_k") <= SAMPLE).join(full, "a").select("a", "b"), "sample")
        items = self.texts(some).select("a", "b", "text_a", "text_b").mapInArrow(outside(self.similar, whole=True), "a long, b long, items array<long>")
        counts = items.select("a", F.explode("items").alias("item")).groupBy("a", "item").agg(F.count("*").alias("c")).filter("c > 1")
        out = counts.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "item"))), lambda x: x["item"]).alias("common"))
        out = self.scratch.table(out, "common")
        self.scratch.drop(some)
        return out

    def split(self, many: DataFrame) -> DataFrame:
        """New buckets (bucket, node, size, by_size) of the members ``many(a, b, size, label)`` that their leaders a don't settle."""
        common = self.common(many)
        of_leader = many.groupBy("a").agg(F.min("size").alias("least")).join(common, "a", "left")
        with_text = self.texts(many, of_leader).select("a", "b", "text_a", "text_b", "least", "common")
        parts = with_text.mapInArrow(outside(self.similar), "a long, b long, items array<long>")
        items = parts.join(many, ["a", "b"]).select("a", "b", "size", "label", F.explode("items").alias("item"))
        items = self.scratch.table(items.select(F.xxhash64("a", "item").alias("bucket"), F.col("b").alias("node"), "size", "label", F.col("item").isNull().alias("by_size")), "outside")
        shared = items.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("bucket")
        shared = self.scratch.table(shared, "open")
        out = self.different(items.join(shared, "bucket").select("bucket", "node", "size", "by_size"))
        self.scratch.drop(common, items, shared)
        return out

    def classes(self, active: DataFrame) -> DataFrame | None:
        """node, label of all nodes that are linked to others, from buckets (bucket, node, size)."""
        active = self.different(active.withColumn("by_size", F.lit(False)))
        # most members meet the same few leaders in many buckets; one leader each is a start
        lead = self.led(active, None)
        if is_empty(lead):
            return None
        start = active.join(lead, "bucket").filter("node <> a").groupBy("node").agg(F.min("_place").alias("l")).select(F.col("l.node").alias("a"), F.col("node").alias("b"))
        labels, most = self.linked(None, start), SMALL
        while True:
            self.scratch.drop(lead)
            lead = self.led(active, labels)
            if is_empty(lead):
                return labels
            led = self.scratch.table(active.join(lead, "bucket").select("bucket", "node", "size", "by_size", "a", "of", "_place", "n"), "led")
            large = led.filter(F.col("n") > most)
            heads = self.heads(large)
            met = self.scratch.table(large.join(heads, "bucket").filter(F.col("node") != F.col("a")).select("bucket", "node", "size", "a", "of", "head"), "met")
            to_leaders = _labelled(met, labels).filter(F.col("label") != F.col("of")).select("a", F.col("node").alias("b"))
            to_heads = met.filter(F.col("head") != F.col("node")).select(F.col("head").alias("a"), F.col("node").alias("b"))
            pairs = to_leaders.union(to_heads).union(self.paired(_labelled(led.filter(F.col("n") <= most), labels))).distinct()
            labels = self.linked(labels, pairs)
            # leaders and heads have met all others of their bucket; what is still open is between the others
            members = self.scratch.table(_labelled(met.filter(F.col("head") != F.col("node")), labels).select("bucket", "node", "size", "head", "label"), "members")
            still = self.scratch.table(members.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high").select("bucket"), "still")
            many = self.scratch.table(members.join(still, "bucket").select(F.col("head").alias("a"), F.col("node").alias("b"), "size", "label").distinct(), "many")
            self.scratch.drop(still, heads, led, met, members, active)
            if is_empty(many):
                return labels
            active, most = self.split(many), most * GROWTH
            self.scratch.drop(many)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: id_col, class_id, class_size, kept, the text's ``_digest`` and the class as ``_label``.

    class_id is the least id of the class, and the row that has it is kept. ``similar`` may be
    0.8 or more: the bands are laid out for that (a pair of similarity s shares no bucket with
    probability (1 - s^5)^30, so of pairs at 0.7 alike 0.4 percent would be missed).
    """
    if not SIMILAR <= similar <= 1:
        raise ValueError(f"similar must be from {SIMILAR} to 1, for which the bands are laid out")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"), digest(text_col).alias("_digest"))
    signs = scratch.table(texts.mapInArrow(signed, f"_id {id_type}, _digest binary, size long, bytes long, bands array<long>"), "signatures")
    # equal texts are one node
    nodes = signs.groupBy("_digest").agg(F.min(F.struct("_id")).alias("_first"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bytes").alias("bytes"), F.count("*").alias("_n"))
    nodes = scratch.table(nodes.select("_digest", F.col("_first._id").alias("_first"), "bands", "size", "bytes", "_n").withColumn("node", F.monotonically_increasing_id()), "nodes")
    in_bands = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    # written out, so that both sides of the join are dealt anew and a hot bucket can be split
    shared = scratch.table(in_bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    active = scratch.table(in_bands.join(shared, "bucket").select("bucket", "node", "size"), "buckets")
    scratch.drop(shared)
    some = active.select("node").distinct()
    wanted = scratch.table(nodes.join(some, "node").select("node", "bytes", F.col("_first").alias("_f"), F.col("_digest").alias("_g")), "wanted")
    size = wanted.agg(F.sum("bytes")).first()[0] or 0
    found = texts.join(small(wanted), F.col("_id").eqNullSafe(F.col("_f")) & (F.col("_digest") == F.col("_g"))).select("node", F.col("_text").alias("text"))
    bodies = scratch.bucketed(found, "node", buckets_for(spark, size), "texts")
    scratch.drop(wanted)
    labels = _Settling(bodies, similar, scratch).classes(active)
    classed = nodes.select("node", "_digest", "_first", "_n")
    classed = classed.join(labels, "node", "left") if labels is not None else classed.withColumn("label", F.col("node"))
    classed = scratch.table(classed.select("_digest", "_first", "_n", F.coalesce("label", "node").alias("label")), "classes")
    totals = scratch.table(classed.groupBy("label").agg(F.sum("_n").alias("class_size"), F.min(F.struct("_first")).alias("_least")), "totals")
    named = scratch.table(classed.join(totals, "label").select("_digest", F.col("_least._first").alias("class_id"), "class_size", F.col("label").alias("_label")), "named")
    rows = signs.select("_id", "_digest")
    scratch.clear(signs, named)
    out = rows.join(named, "_digest")
    return out.select(F.col("_id").alias(id_col), "class_id", "class_size", F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"), "_digest", "_label")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with their columns."""
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **options)
    # of the rows with the least id of a class, those with the least text stay, and one of these
    many = groups.filter("class_size > 1")
    firsts = materialise(many.filter("kept").groupBy(F.col("_label").alias("_class")).agg(F.min("_digest").alias("_keep")), "firsts")
    of_row = materialise(many.groupBy(F.col(id_col).alias("_id"), "_label", "_digest", "kept").agg(F.count("*").alias("_copies")), "members")
    first = F.col("kept") & (F.col("_digest") == F.col("_keep"))
    gone = beside(of_row, firsts, F.col("_label") == F.col("_class")).withColumn("_stay", first.cast("int")).filter("_copies > _stay")
    return drop_rows(docs, gone, id_col, text_col)
