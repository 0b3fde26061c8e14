import zlib

import numpy as np
import pyarrow as pa

from lodestrata.llm import quality_classifier as qc


def test_held_out_accuracy_and_labels_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = qc.classify(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out]
    assert len(test) > 500
    good = [r.score for r in test if r.quality == 1]
    bad = [r.score for r in test if r.quality == 0]
    ranks = np.argsort(np.argsort(good + bad))
    auc = (ranks[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    assert auc > 0.97
    assert np.mean([r.predicted == r.quality for r in test]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_scores_match_brute_force(spark, documents):
    """Sums, shrinkage, prior and densities rebuilt from the statistics with numpy's own inverse and determinant."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = documents.select("doc_id", "text").collect()
    x = qc.statistics(pa.array([r.text for r in rows]))
    known = {r.doc_id: r.quality for r in labels.collect()}
    train = [k for k, r in enumerate(rows) if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5]
    parts = [x[[k for k in train if known[rows[k].doc_id] == c]] for c in (0, 1)]
    own = [np.cov(p.T, bias=True) for p in parts]
    n = [len(p) for p in parts]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    density = []
    for c in (0, 1):
        cov = 0.95 * (0.8 * own[c] + 0.2 * pooled) + 0.05 * spread + 1e-9 * np.eye(len(spread))
        d = x - parts[c].mean(0)
        density.append(np.log(n[c] / sum(n)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    want = dict(zip([r.doc_id for r in rows], 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700))), strict=True))
    got = {r.doc_id: r.score for r in qc.classify(documents, labels).collect()}
    assert min(n) > 5 and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_long_texts_are_counted_in_segments(monkeypatch, documents):
    texts = pa.array([r.text for r in documents.select("text").limit(30).collect()])
    whole = qc.statistics(texts)
    monkeypatch.setattr(qc, "SEGMENT", 1000)
    assert np.allclose(qc.statistics(texts), whole)


def test_changed_held_out_labels_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", __import__("pyspark").sql.functions.when(qc.held_out("doc_id"), 1 - labels.quality).otherwise(labels.quality))
    a, b = ({r.doc_id: r.score for r in qc.classify(documents, x).collect()} for x in (labels, turned))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_statistics_of_small_texts():
    x = qc.statistics(pa.array(["", None, "A a", "one one one\none one one", "é" * 10]))
    assert x.shape == (5, len(qc.STATISTICS)) and np.isfinite(x).all()
    at = qc.STATISTICS.index
    assert x[2][at("words")] == np.log1p(2) and x[3][at("stutter")] == np.sqrt(5 / 6)
    assert x[3][at("dup_lines")] == np.sqrt(0.5) and x[4][at("beyond_ascii")] == 1


def test_scores_are_gaussian_log_density_differences():
    rng = np.random.default_rng(0)
    d = len(qc.STATISTICS)
    x0, x1 = rng.normal(size=(300, d)), rng.normal(size=(500, d)) * 1.5 + 0.3
    sums = {c: np.concatenate([[len(x)], x.sum(0), (x.T @ x).reshape(-1)]) for c, x in ((0, x0), (1, x1))}
    model = qc.discriminant(sums, 0.2, 0.05)
    probe = rng.normal(size=(20, d))

    def log_density(c):
        cov = model.factor[c] @ model.factor[c].T
        diff = probe - model.mean[c]
        return model.log_share[c] - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))

    want = 1 / (1 + np.exp(log_density(0) - log_density(1)))
    assert np.allclose(model.scores(probe), want)


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 0), (None, 1)], "doc_id long, quality int")
    rows = qc.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.classify(odd, none).collect()} == {0.5}
    assert qc.classify(empty, labels).count() == 0
