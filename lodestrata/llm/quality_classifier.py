"""A document quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (``STATISTICS``). From the labelled rows
come, for each class, count, sum and sum of outer products: numbers whose size depends on the
statistics alone, so all labelled rows are used. A class covariance is shrunk towards the pooled
one and that towards a multiple of the identity; its Cholesky factor is worked out once and
sent with the model. A score is the logistic function of the difference of the two Gaussian log
densities, each from a Mahalanobis distance by forward substitution, plus the log ratio of the
class sizes.

Defined cases: a null or empty text has the statistics of an empty text and gets a score; very
long texts are measured whole, in segments; other columns, whatever their names, aren't read; a
null id is held out; labels other than 0 and 1 (null too) are left out, and of several labels for
one id the largest counts; if a class has no rows all scores are the share of label 1, or 0.5
without labels; rows that agree in id are scored one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, materialise, slices, text_bytes, text_or_empty, words

STATISTICS = ["words", "word_length", "upper", "digit", "symbol", "shout", "stop", "comma", "other", "beyond_ascii", "newline", "dup_lines", "distinct", "stutter"]
_KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#*$%&|<>", "shout": "!?", "stop": ".", "comma": ",;:", "newline": "\n", "blank": " \t\r\v\f", "lower": "abcdefghijklmnopqrstuvwxyz"}
_NAMES = [*_KINDS, "beyond_ascii", "other"]
_KIND = np.full(256, _NAMES.index("other"), np.int64)
_KIND[128:] = _NAMES.index("beyond_ascii")
for _k, _letters in enumerate(_KINDS.values()):
    _KIND[[ord(c) for c in _letters]] = _k


def statistics(column) -> np.ndarray:
    """One row of STATISTICS for each text."""
    data, at = text_bytes(column)
    n = len(at) - 1
    size = np.diff(at)
    count = np.zeros(n * len(_NAMES))
    for low in range(0, len(data), SEGMENT):  # some bytes at a time, so a very long text needs little more than its size
        part = data[low : low + SEGMENT]
        row = np.searchsorted(at, np.arange(low, low + len(part)), side="right") - 1
        kinds, many = np.unique(row * len(_NAMES) + _KIND[part], return_counts=True)
        count[kinds] += many
    count = count.reshape(n, -1)
    of, word = words(data, at)
    total = np.bincount(of, minlength=n).astype(float)
    same = np.bincount(of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((word, of))
    new = np.ones(len(of), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    dup = np.zeros(n)
    for k, text in enumerate(column.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        dup[k] = (len(lines) - len(set(lines))) / max(1, len(lines))
    share = np.sqrt(count / np.maximum(1, size)[:, None])
    per_word = np.maximum(1, total)
    out = {name: share[:, _NAMES.index(name)] for name in _NAMES}
    out |= {"words": np.log1p(total), "word_length": np.log1p((size - count[:, _NAMES.index("blank")] - count[:, _NAMES.index("newline")]) / per_word)}
    out |= {"dup_lines": np.sqrt(dup), "stutter": np.sqrt(same / per_word)}
    # distinct words fall with length in any prose; held against what a text of that length has
    out |= {"distinct": distinct / per_word * np.log1p(total)}
    return np.column_stack([out[name] for name in STATISTICS])


def measured(batches):
    for whole in batches:
        for batch in slices(whole, "_text"):
            x = statistics(batch.column("_text"))
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), vectors], names=["_id", "x"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(batches):
    """Count, sums and products of each batch and class, end to end."""
    for batch in batches:
        if batch.num_rows:
            label, x = batch.column("label").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
            there = np.unique(label)
            parts = [np.concatenate([[np.sum(label == c)], x[label == c].sum(0), (x[label == c].T @ x[label == c]).reshape(-1)]) for c in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))], names=["label", "sums"])


@dataclass
class Discriminant:
    """Means, Cholesky factors, log determinants and log shares of the classes 0 and 1."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_det: list[float]
    log_share: list[float]
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = []
        for mean, factor, log_det, log_share in zip(self.mean, self.factor, self.log_det, self.log_share, strict=True):
            y = np.empty_like(x)
            for k in range(x.shape[1]):  # forward substitution, all rows at once
                y[:, k] = (x[:, k] - mean[k] - y[:, :k] @ factor[k, :k]) / factor[k, k]
            log_density.append(log_share - 0.5 * (log_det + (y * y).sum(1)))
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def discriminant(sums: dict[int, np.ndarray], towards_pooled: float, towards_identity: float) -> Discriminant:
    d = len(STATISTICS)
    n = {c: sums[c][0] if c in sums else 0 for c in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant([], [], [], [], constant=n[1] / sum(n.values()) if sum(n.values()) else 0.5)
    mean = {c: sums[c][1 : d + 1] / n[c] for c in n}
    own = {c: sums[c][d + 1 :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in n}
    pooled = sum(n[c] * own[c] for c in n) / sum(n.values())
    # scale-free: the identity is that of standardised statistics
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factor = []
    for c in n:
        mixed = (1 - towards_pooled) * own[c] + towards_pooled * pooled
        mixed = (1 - towards_identity) * mixed + towards_identity * np.diag(spread**2)
        factor.append(np.linalg.cholesky(mixed + 1e-9 * np.eye(d)))
    return Discriminant([mean[0], mean[1]], factor, [2 * np.log(np.diag(f)).sum() for f in factor], [float(np.log(n[c] / sum(n.values()))) for c in n])


def scored(model):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(model.value.scores(x), pa.float64())], names=["_id", "score"])

    return run


def held_out(name: str) -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = 0.3, towards_pooled: float = 0.2, towards_identity: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score (how likely label 1 is), predicted."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    vectors = materialise(texts.mapInArrow(measured, f"_id {id_type}, x array<double>"), "statistics")
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = vectors.filter(~held_out("_id")).join(known, "_id").select("label", "x")
    parts = rows.mapInArrow(summed, "label int, sums array<double>").select("label", F.posexplode("sums").alias("k", "v"))
    numbers = parts.groupBy("label", "k").agg(F.sum("v").alias("v")).collect()  # 2 x (1 + d + d * d)
    sums: dict[int, np.ndarray] = {}
    for r in numbers:
        sums.setdefault(r["label"], np.zeros(1 + len(STATISTICS) + len(STATISTICS) ** 2))[r["k"]] = r["v"]
    model = spark.sparkContext.broadcast(discriminant(sums, towards_pooled, towards_identity))
    out = vectors.mapInArrow(scored(model), f"_id {id_type}, score double")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
