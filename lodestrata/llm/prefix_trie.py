"""The trie of conversation prefixes, by intervals of its preorder.

A node is a distinct sequence of first turns, the root the empty one. Every turn has a symbol, the
digest of its role and text, and every prefix the sums of four 31-bit hashes of its symbols with
their places; such sums are running sums, so one long conversation is shared out among tasks, and
equal depth and sums name a node (124 bits).

Equal conversations are first brought together with how many they are. One of each kind goes on;
they are ranked lexicographically by their symbols: 64 symbols make a key, equal keys get
their place in the order as a new symbol, and so on until a conversation is one key. A node's
members then lie side by side, from the first to the last conversation that begins with it; by the
first and the depth all nodes stand in preorder, and a subtree is the interval from its node to the
last node that begins at or before the node's last conversation. Leaves and savings are running
sums over the preorder, so a subtree's are the difference of two.

Conversations that end at a node are written as runs of ids in order, and a node's runs are read in
order by a hash that holds no more than one run.

Defined cases: turns are ordered by turn, null first, then by role and text; null roles and texts
count as empty, rows that are repeated are turns of their own, and rows without a conversation id
belong to none; an empty table has no nodes; other columns, whatever their names, aren't read.
Turns may be very long (only digests and lengths go on) and conversations may have any number.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, looked_up, materialise
from .scan import scan

#: Symbols in a key, and the characters of one.
KEY, WIDTH = 64, 32
#: Ids in a run.
RUN = 4096
SUMS = ("s1", "s2", "s3", "s4")
NOTHING = hashlib.sha256(b"").hexdigest()


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Numbered turns: conv, depth (from 1), symbol, chars (code points of the text)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("_turn"), role.alias("_role"), text.alias("_text"))
    symbol = F.substring(F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256), 1, WIDTH)
    rows = rows.select("*", symbol.alias("symbol"), F.char_length("_text").cast("long").alias("chars"), F.lit(1).alias("_one"))
    return scan(rows, ["conv", "_turn", "_role", "_text"], ["conv", "symbol", "chars"], runs={"depth": "_one"}, segment="conv")


def members_of(turns: DataFrame) -> DataFrame:
    """conv, n: how many turns each conversation has."""
    return turns.groupBy("conv").agg(F.max("depth").alias("n"))


def replanted(turns: DataFrame, family: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does: (turns, members), as ``trie`` takes them.

    Conversation c gets the first h turns of c - c % family (all if there are fewer), then its own
    after its first h, with h = crc32(c in decimals) % kinds. Remainders have the sign of c, as in SQL.
    """
    turns = materialise(turns, "turns")
    convs = materialise(members_of(turns), "members")
    h, base = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(kinds)), F.col("conv") - F.col("conv") % family
    first = convs.filter(F.col("conv") % family == 0).select(F.col("conv").alias("_base"), F.col("n").alias("_n_base"))
    told = convs.withColumn("_h", h).withColumn("_of", base)
    told = told.join(first, told["_of"] == first["_base"], "left").withColumn("_k", F.least("_h", F.coalesce("_n_base", F.lit(0))))
    told = materialise(told.select(F.col("conv").alias("_conv"), "_of", "_h", "_k", "n"), "heads")
    own = looked_up(turns, "conv", told.select("_conv", "_h", "_k", F.col("n").alias("_asked")), "_conv", "_asked")
    own = own.filter(F.col("depth") > F.col("_h")).select("conv", (F.col("_k") + F.col("depth") - F.col("_h")).alias("depth"), "symbol", "chars")
    openers = turns.filter((F.col("depth") < kinds) & (F.col("conv") % family == 0))  # a family's: fewer than kinds turns, family members at most
    heads = told.join(openers, (told["_of"] == openers["conv"]) & (F.col("depth") <= F.col("_h"))).select(F.col("_conv").alias("conv"), "depth", "symbol", "chars")
    return own.unionByName(heads), told.select(F.col("_conv").alias("conv"), (F.col("_k") + F.greatest(F.col("n") - F.col("_h"), F.lit(0))).alias("n"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the name of the node it leads to and of that one's parent."""
    terms = []
    for k in (0, 1):
        x = F.xxhash64("symbol", "depth", F.lit(k))
        terms += [x.bitwiseAND(0x7FFFFFFF).alias(f"t{2 * k + 1}"), F.shiftrightunsigned(x, 33).alias(f"t{2 * k + 2}")]
    hashed = materialise(turns.select("conv", "depth", "symbol", "chars", *terms), "hashed")
    summed = scan(hashed, ["conv", "depth"], ["conv", "depth", "symbol", "chars", "t1", "t2", "t3", "t4"], runs=dict(zip(SUMS, ("t1", "t2", "t3", "t4"), strict=True)), segment="conv")
    sums = [F.col(s) for s in SUMS]
    parent = _name(F.col("depth") - 1, [s - F.col(f"t{k}") for k, s in enumerate(sums, 1)])
    return materialise(summed.select("conv", "depth", "symbol", "chars", _name(F.col("depth"), sums).alias("node"), parent.alias("parent")), "prefixes")


def ranked(paths: DataFrame, turnless: DataFrame) -> DataFrame:
    """conv, place: the lexicographic rank of each conversation from 1; ``paths(conv, depth, symbol)`` are distinct, ``turnless(conv)`` has one row at most."""
    rows = paths.select("conv", (F.col("depth") - 1).alias("_at"), F.col("symbol").alias("_value"))
    while True:
        listed = F.array_sort(F.collect_list(F.struct("_at", "_value")))  # KEY symbols at most
        keys = rows.groupBy("conv", F.floor(F.col("_at") / KEY).alias("_block")).agg(F.array_join(F.transform(listed, lambda x: x["_value"]), "").alias("_key"))
        keys = materialise(keys.unionByName(turnless.select("conv", F.lit(0).cast("long").alias("_block"), F.lit("").alias("_key"))).withColumn("_one", F.lit(1)), "keys")
        order, keep = ["_key", "conv", "_block"], ["conv", "_block"]
        if is_empty(keys.filter("_block > 0")):
            return scan(keys, order, ["conv"], totals={"place": "_one"})
        # equal keys have the place of the first of them as their new symbol, the turnless one too
        placed = scan(keys, order, keep, runs={"_within": "_one"}, totals={"_place": "_one"}, segment="_key")
        rows = placed.select("conv", F.col("_block").alias("_at"), F.lpad(F.hex(F.col("_place") - F.col("_within")), WIDTH, "0").alias("_value"))
        turnless = turnless.limit(0)


def _runs(batches):
    """Sorted rows (node, conv) to runs of ids."""
    node, first, ids = None, None, []

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["node", "_first", "_ids"])

    for batch in batches:
        for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if ids and (key != node or len(ids) == RUN):
                yield closed()
                ids = []
            if not ids:
                node, first = key, conv
            ids.append(str(conv))
    if ids:
        yield closed()


def _hashed(batches):
    """Sorted runs to one digest a node."""
    node, state = None, None
    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["_node", "ends_sha256"])
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["_node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """For each node where conversations of ``ends(conv, node)`` end: SHA-256 of their ids in order, comma-joined."""
    runs = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_runs, "node binary, _first long, _ids string")
    return runs.repartition("node").sortWithinPartitions("node", "_first").select("node", "_ids").mapInArrow(_hashed, "_node binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the conversations with these ``turns(conv, depth, symbol, chars)``; ``members(conv, n)`` has the turnless ones too.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, then preorder and subtree_end (from 1, last included) and symbol of the last turn.
    """
    members = materialise(members, "members")
    prefixes = _prefixes(turns)
    root = _name(F.lit(0), [F.lit(0)] * 4)
    last = prefixes.groupBy("conv").agg(F.max_by("node", "depth").alias("node"))
    ends = materialise(members.join(last, "conv", "left").select("conv", "n", F.coalesce("node", root).alias("node")), "ends")
    kinds = materialise(ends.groupBy("node").agg(F.min("conv").alias("_rep"), F.count("*").alias("_weight"), F.max("n").alias("_asked")), "kinds")
    chosen = materialise(looked_up(prefixes, "conv", kinds.select("_rep", "_weight", "_asked"), "_rep", "_asked"), "chosen")
    places = ranked(chosen, kinds.filter("_asked = 0").select(F.col("_rep").alias("conv")))
    placed = materialise(places.withColumnRenamed("conv", "_rep").join(kinds.select("_rep", "_weight", "_asked"), "_rep"), "places")
    rows = looked_up(chosen, "conv", placed.select("_rep", "place", "_asked"), "_rep", "_asked")
    merged = [F.min("place").alias("first"), F.max("place").alias("last"), F.sum("_weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), F.max("symbol").alias("symbol"), F.max("parent").alias("parent")]
    nodes = rows.groupBy("node", "depth").agg(*merged)
    whole = placed.agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("_weight").alias("n_convs"), F.min("_rep").alias("conv_id")).filter("first IS NOT NULL")
    whole = whole.select(root.alias("node"), F.lit(0).cast("long").alias("depth"), "*", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("binary").alias("parent"))
    nodes = materialise(nodes.unionByName(whole), "nodes")
    below = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("_n"))
    nodes = nodes.join(below, F.col("node") == F.col("_of"), "left").withColumn("n_children", F.coalesce("_n", F.lit(0).cast("long"))).drop("_of", "_n")
    nodes = nodes.withColumn("_leaf", (F.col("n_children") == 0).cast("long")).withColumn("_own", (F.col("n_convs") - 1) * F.col("chars")).withColumn("_one", F.lit(1))
    nodes = materialise(nodes, "weighed")
    columns = ["node", "parent", "depth", "first", "last", "conv_id", "n_convs", "n_children", "symbol", "_leaf", "_own"]
    nodes = materialise(scan(nodes, ["first", "depth"], columns, totals={"preorder": "_one", "_leaves": "_leaf", "_saved": "_own"}), "preorder")
    # where a subtree ends: at the last node that begins with its last conversation
    asked = nodes.groupBy(F.col("last").alias("_last")).agg(F.count("*").alias("_asked"))
    stops = nodes.groupBy(F.col("first").alias("_stop")).agg(*[F.max(c).alias(f"_to_{c}") for c in ("preorder", "_leaves", "_saved")])
    stops = materialise(stops.join(asked, F.col("_stop") == F.col("_last")).drop("_last"), "stops")
    nodes = looked_up(nodes, "last", stops, "_stop", "_asked")
    nodes = nodes.withColumn("n_leaves", F.col("_to__leaves") - F.col("_leaves") + F.col("_leaf")).withColumn("saved_tokens", F.col("_to__saved") - F.col("_saved") + F.col("_own"))
    nodes = materialise(nodes.select("node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "preorder", F.col("_to_preorder").alias("subtree_end"), "symbol"), "subtrees")
    inner = nodes.filter("n_children > 0").select(F.col("node").alias("_of"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_asked"))
    children = looked_up(nodes.filter("parent IS NOT NULL"), "parent", inner, "_of", "_asked")
    both = children.unionByName(nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = both.join(end_digests(ends), F.col("node") == F.col("_node"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "preorder", "subtree_end", "symbol")


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the conversations as they stand."""
    turns = materialise(ordered_turns(conversations, **columns), "turns")
    return trie(turns, members_of(turns))
