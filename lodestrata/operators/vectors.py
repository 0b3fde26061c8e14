"""Approximate nearest neighbours: vectors in cells around centres, exact distances within the nearest cells.

The centres are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors); every vector
is then filed under its nearest centre, in folders by cell. A question reads the files of its
nearest cells only and ranks what is there by exact distance. How many cells that takes is
measured when the index is written: vectors of the sample ask for their nearest among the sample,
and the least number of cells that finds ``RECALL`` of them is kept with the index.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from . import blocks, rank

#: Vectors that centres are fitted on at most, and how many of them test the index.
SAMPLE, ASKING = 50_000, 500
ROUNDS, NEIGHBOURS, RECALL = 12, 10, 0.97
MOST_CELLS = 4096
#: Centres that a task holds while filing.
BATCH = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(sample: np.ndarray, cells: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length; a centre that loses all its vectors takes the one farthest from its own."""
    x = _unit(sample.astype(np.float64))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        own = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(1))[: len(empty)]]
        centres = _unit(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = NEIGHBOURS, asking: int = ASKING) -> int:
    """The least number of cells in which questions of the sample find that share of their ``k`` nearest."""
    x = _unit(sample.astype(np.float64))
    cell = (x @ centres.T).argmax(1)
    q = x[np.random.default_rng(1).choice(len(x), min(asking, len(x)), replace=False)]
    nearest = np.argsort(-(q @ x.T), axis=1)[:, :k]
    order = np.argsort(-(q @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)  # where each cell comes for a question
    needed = np.take_along_axis(place, cell[nearest], 1)
    return int(np.sort(needed.ravel())[max(0, math.ceil(recall * needed.size) - 1)]) + 1


class VectorIndex:
    """Cells of vectors below ``root``, written once for a table of (key, vector)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id"):
        self.spark, self.key = spark, key
        self.store = Store(spark, root, {"vectors": ["cell"]})

    def exists(self) -> bool:
        return self.store.read("cells") is not None

    def build(self, vectors: DataFrame, vector_col: str = "embedding", cells: int | None = None, recall: float = RECALL) -> VectorIndex:
        rows = vectors.select(self.key, F.col(vector_col).cast("array<float>").alias("vector")).filter("vector IS NOT NULL AND size(vector) > 0")
        n = rows.count()
        # the sample: those whose hash is least, whatever the partitioning
        share = min(1.0, 1.2 * SAMPLE / n) if n else 0.0
        picked = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
        taken = picked.orderBy(F.xxhash64(self.key), self.key).limit(SAMPLE).collect()  # SAMPLE vectors at most
        sample = np.array([r["vector"] for r in taken], np.float32)
        if not len(sample):
            self.store.write("vectors", rows.withColumn("cell", F.lit(0)))
            self.store.write("cells", self.spark.createDataFrame([], "cell int, centre array<double>, probes int"))
            return self
        count = cells or max(1, min(MOST_CELLS, len(sample), round(math.sqrt(n))))
        centres = fit(sample, count)
        centres = centres[np.unique((_unit(sample.astype(np.float64)) @ centres.T).argmax(1))]  # those that have vectors
        probes = probes_for(sample, centres, recall)
        sent = self.spark.sparkContext.broadcast(centres.astype(np.float32))  # MOST_CELLS centres at most
        names = [f.name for f in rows.schema]

        def filed(batches):
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                for low in range(0, batch.num_rows, BATCH):
                    part = batch.column("vector").slice(low, BATCH)
                    cell[low : low + BATCH] = (np.stack(part.to_numpy(zero_copy_only=False)) @ sent.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*names, "cell"])

        kind = rows.schema[self.key].dataType.simpleString()
        out = rows.mapInArrow(filed, f"`{self.key}` {kind}, vector array<float>, cell int")
        self.store.write("vectors", out.repartitionByRange("cell", self.key).sortWithinPartitions("cell"))
        self.store.write("cells", self.spark.createDataFrame([(k, [float(v) for v in c], probes) for k, c in enumerate(centres)], "cell int, centre array<double>, probes int"))
        return self

    def _sent(self, questions: DataFrame, probes: int | None):
        """The vectors of a stated set of questions, checked to be small, with MOST_CELLS centres at most, for every task; and the questions' ids."""
        asked = questions.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        rank._checked(asked, F.size("vector"))
        listed = asked.toArrow()
        cells = self.store.read("cells").orderBy("cell").collect()
        centres = np.array([r["centre"] for r in cells], np.float64) if cells else np.zeros((0, 0))
        most = (cells[0]["probes"] if cells else 0) if probes is None else probes
        return self.spark.sparkContext.broadcast((listed.column(1).combine_chunks(), centres, most)), listed.column(0).to_pylist()

    def probed(self, questions: DataFrame, probes: int | None = None) -> DataFrame:
        """query_id, cell: each question with its nearest cells; ``questions`` is a stated set, checked to be small."""
        sent, ids = self._sent(questions, probes)

        def run(batches):
            for batch in batches:
                for low in batch.column(0).to_pylist():
                    asked, centres, most = sent.value
                    starts, numbers = blocks.probing(asked.slice(low, blocks.ASKING), centres, most)
                    yield pa.RecordBatch.from_arrays([pa.array(low + numbers), pa.array(np.repeat(np.arange(len(centres), dtype=np.int32), np.diff(starts)))], names=["_q", "cell"])

        pairs = self.spark.range(0, len(ids), blocks.ASKING).mapInArrow(run, "_q long, cell int")
        return rank._named(pairs, ids, questions.schema["query_id"].dataType.simpleString())

    def search(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, distance, rank: the ``k`` nearest of the cells that a question probes.

        Each task holds the stated questions and measures the rows of a cell, in blocks, against those
        that probe it; it keeps ``k`` rows of a question before anything is shuffled.
        """
        wanted = [r["cell"] for r in self.probed(questions, probes).select("cell").distinct().collect()]  # MOST_CELLS at most
        sent, ids = self._sent(questions, probes)
        rows = self.store.read("vectors").filter(F.col("cell").isin(wanted)).select(self.key, F.col("vector").alias("_v"), "cell")
        parts = max(2, 2 * self.spark.sparkContext.defaultParallelism)
        # few cells to a task, a large one over several; in the order of keys, so that of equal distances the first stays
        dealt = rows.repartitionByRange(parts, "cell", self.key).sortWithinPartitions(self.key)
        key, kind = self.key, rows.schema[self.key].dataType.simpleString()

        def run(batches):
            asked, centres, most = sent.value
            for q, value, keys in blocks.by_cosine(asked, key, k, batches, blocks.probing(asked, centres, most)):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(value), keys], names=["_q", "_d", key])

        found = rank._named(dealt.mapInArrow(run, f"_q long, _d double, `{key}` {kind}"), ids, questions.schema["query_id"].dataType.simpleString())
        scored = found.select("query_id", key, F.when(F.col("_d") < blocks.NAN, F.col("_d")).otherwise(F.lit(float("nan"))).alias("distance"))
        return rank.top(scored, ["query_id"], ["distance", key], k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """query_id, recall: the share of a question's exact neighbours that was found; equal distances count as found."""
    worst = exact.groupBy("query_id").agg(F.max("distance").alias("_worst"), F.count("*").alias("_n"))
    good = found.join(worst, "query_id").filter(F.col("distance") <= F.col("_worst")).groupBy("query_id").agg(F.count("*").alias("_good"))
    return worst.join(good, "query_id", "left").select("query_id", (F.least(F.coalesce("_good", F.lit(0)), F.col("_n")) / F.col("_n")).alias("recall"))
