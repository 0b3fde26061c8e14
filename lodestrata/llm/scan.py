"""Running sums over a whole sorted table, distributed: each task sums its stretch, then gets what came before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stretch(keep: list[str], names: list[str], segment: str | None, runs: dict[str, str], totals: dict[str, str]):
    """Sums within one task's stretch of the order; ``_head``: the row belongs to the segment that opens the stretch."""

    def run(batches):
        part, last, head, at = TaskContext.get().partitionId(), None, True, 0
        carried = dict.fromkeys([*runs, *totals], 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            if segment is not None:
                key = batch.column(segment)
                change[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                change[0] = at > 0 and key[0].as_py() != last
                last = key[n - 1].as_py()
            start = np.maximum.accumulate(np.where(change, np.arange(n), -1))
            out = {}
            for name, of in (runs | totals).items():
                value = batch.column(of).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(value)
                before = np.where(start >= 0, total[start] - value[start], -carried[name]) if name in runs else -carried[name]
                out[name] = total - before
                carried[name] = int(out[name][-1])
            heads = head & ~np.logical_or.accumulate(change)
            head = bool(heads[-1])
            columns = [*(batch.column(c) for c in keep), *(pa.array(out[c], pa.int64()) for c in names), pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(heads)]
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names, "_part", "_at", "_head"])

    return run


def scan(df: DataFrame, order: list[str], keep: list[str], runs: dict[str, str] | None = None, totals: dict[str, str] | None = None, segment: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` and running sums, each of a row and all rows before it by ``order``.

    ``totals`` names sums over the whole table by the whole-number columns they add up, ``runs``
    sums that begin anew wherever column ``segment``, the first of ``order`` and without nulls,
    changes. Rows are dealt by ranges of the whole order, so one segment may lie in many tasks;
    only one row a task goes through the driver. The result is written to shared storage.
    """
    runs, totals = runs or {}, totals or {}
    names = [*runs, *totals]
    spark, types = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    kind = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} long" for c in names), "_part long", "_at long", "_head boolean"])
    inside = list(dict.fromkeys([*([segment] if segment else []), *keep, *runs.values(), *totals.values()]))
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*inside)
    marked = keep if segment is None or segment in keep else [*keep, segment]
    if marked is not keep:
        kind = f"`{segment}` {types[segment]}, {kind}"
    keep_all = keep if marked is keep else [segment, *keep]
    out = materialise(sorted_rows.mapInArrow(_stretch(keep_all, names, segment, runs, totals), kind), "scan")
    name = F.sha2(F.col(segment).cast("string"), 256) if segment else F.lit("")
    last = F.max_by(F.struct(*names, "_head", name.alias("_key")), "_at").alias("last")
    ends = out.groupBy("_part").agg(F.min_by(name, "_at").alias("first"), last).collect()  # a row for each task
    before, sums, key = [], dict.fromkeys(names, 0), None
    for row in sorted(ends, key=lambda r: r["_part"]):
        into = {c: sums[c] if c in totals or row["first"] == key else 0 for c in names}
        before.append((row["_part"], *into.values()))
        sums = {c: row["last"][c] + (into[c] if c in totals or row["last"]["_head"] else 0) for c in names}
        key = row["last"]["_key"]
    if not before:
        return out.select(*keep, *names)
    offsets = spark.createDataFrame(before, ", ".join(["_part long", *(f"_before_{c} long" for c in names)]))
    both = out.join(F.broadcast(offsets), "_part")
    added = [(F.col(c) + (F.col(f"_before_{c}") if c in totals else F.when(F.col("_head"), F.col(f"_before_{c}")).otherwise(0))).alias(c) for c in names]
    return both.select(*keep, *added)
