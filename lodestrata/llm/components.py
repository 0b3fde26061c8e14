"""Connected components of an edge table, by rounds of joins over shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_empty


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, label for every node of ``edges(a, b)``: label is the least node of its component.

    Each round hangs every node on its least neighbour, follows those pointers until they stand
    still, and carries on with the edges between different labels only, so a star of any size is
    done in one round and a path in about as many as the logarithm of its length. A round brings
    together one least value for each node and leaves fewer labels, so the rounds end. An empty
    table gives an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    left, labels = scratch.table(edges.select("a", "b").filter("a <> b"), "edges"), None
    while labels is None or not is_empty(left):
        both = left.union(left.select("b", "a"))
        held = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"), F.lit(True).alias("moved")), "parent")
        moved = True
        while moved:  # four steps up at a time
            parent = held.select("node", "up")
            second = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            two = parent.join(second, "up").select("node", F.col("up2").alias("up"))
            above = two.select(F.col("node").alias("up"), F.col("up").alias("up4"))
            further = scratch.table(two.join(above, "up").select("node", F.col("up4").alias("up"), (F.col("up4") != F.col("up")).alias("moved")), "parent")
            scratch.drop(held)
            held, moved = further, not is_empty(further.filter("moved"))
        parent = held.select("node", "up")
        if labels is None:
            labels = scratch.table(parent.select("node", F.col("up").alias("label")), "labels")
        else:
            older, labels = labels, relabelled(labels, parent.select("node", F.col("up").alias("label")), scratch)
            scratch.drop(older)
        up = parent.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        down = parent.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        further = scratch.table(left.join(up, "a").join(down, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "edges")
        scratch.drop(left, held)
        left = further
    scratch.drop(left)
    return labels


def relabelled(labels: DataFrame, newer: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` with the labels of labels; nodes that only ``newer`` has come with it."""
    moved = newer.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return scratch.table(old.union(newer.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after the classes that ``links(a, b)`` join are made one; works on labels, not on all links so far."""
    if labels is None:
        return components(links, scratch)
    if is_empty(links):
        return labels
    ends = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    newer = components(between, scratch)
    out = relabelled(labels, newer, scratch)
    scratch.drop(labels, newer)
    return out
