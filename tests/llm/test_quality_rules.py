import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestrata.llm import quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_match_brute_force(documents, odd):
    for docs in (documents, odd):
        want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.select("doc_id", "text").collect())
        got = quality_rules.judged(docs).collect()
        assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == want
        for r in got:
            failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


def test_repeats_at_ends_and_overlaps(spark):
    texts = ["a b c d e f g h " * 2, "x " * 30, "a b c d e f g h i j a b c d e f g h", "one two three four five six seven eight nine"]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judged(docs).collect()}
    assert got == {k: brute(t)[4] for k, t in enumerate(texts)}


def _stats(spark, x, n_words=None):
    names = list(quality_rules.FEATURES)
    rows = [(k, "en", "s", 10**9 if n_words is None else n_words[k], *map(float, r)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, " + ", ".join(f"{n} double" for n in names))


def _verdicts(spark, x, n_words=None):
    scored = quality_rules.scored(*quality_rules.group_models(_stats(spark, x, n_words))).collect()
    return {r.doc_id for r in scored if r.d2 > quality_rules.LIMIT}


def test_concentration_finds_the_bulk(spark):
    rng = np.random.default_rng(3)
    mix = np.array([[0.3, 0, 0], [0.3, 0.2, 0], [-0.1, 0.2, 0.5]])
    x = np.vstack([rng.normal(0, 1, (900, 3)) @ mix.T + 2, rng.normal(9, 0.2, (200, 3))])
    names = list(quality_rules.FEATURES)
    _, models = quality_rules.group_models(_stats(spark, x))
    (model,) = models.collect()
    assert np.allclose([model[f"m_{n}"] for n in names], 2, atol=0.15)
    cov = np.array([[model[f"c_{a}_{b}"] if (a, b) in quality_rules._pairs() else model[f"c_{b}_{a}"] for b in names] for a in names])
    true = mix @ mix.T  # 550 of the 900 are fitted, so the estimate is somewhat large
    scale = np.trace(cov) / np.trace(true)
    assert 1 < scale < 1.6 and np.allclose(cov / scale, true, atol=0.05)
    out = _verdicts(spark, x)
    assert set(range(900, 1100)) <= out and len(out) < 215


def test_covariance_decides(spark):
    """A vector whose statistics are each ordinary goes if they don't go together."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(800, 1))
    x = np.hstack([z, z + rng.normal(0, 0.1, (800, 1)), rng.normal(size=(800, 1))])
    x[0], x[1] = [1.5, -1.5, 0], [1.5, 1.5, 0]
    out = _verdicts(spark, x)
    assert 0 in out and 1 not in out


def test_factor_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3))
    names = list(quality_rules.FEATURES)
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "_group string, " + ", ".join(f"{n} double" for n in names))
    got = quality_rules._estimates(df.groupBy("_group").agg(*quality_rules._sums()), dict.fromkeys(names, 0.0), 1.0).first()
    low = np.linalg.cholesky(np.cov(x.T, bias=True))
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            assert abs(got[f"l_{a}_{b}"] - low[i, j]) < 1e-6


def test_concentration_with_much_contamination(spark):
    rng = np.random.default_rng(8)
    for bad in (300, 400, 450):
        x = np.vstack([rng.normal(2, 0.5, (1000 - bad, 3)), rng.normal(7, 0.2, (bad, 3))])
        out = _verdicts(spark, x)
        assert set(range(1000 - bad, 1000)) <= out and len(out) <= bad + 15


def test_copies_are_not_what_a_group_is_like(spark):
    """Two thirds of the rows are copies of one text; the others stay all the same, and outliers go."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(2, 0.5, (400, 3)), np.tile([[2.1, 2.0, 1.9]], (800, 1)), [[9, 9, 9]]])
    out = _verdicts(spark, x)
    assert 1200 in out and len(out) <= 6


def test_few_words_scatter_more(spark):
    rng = np.random.default_rng(10)
    x, n = rng.normal(2, 0.1, (600, 3)), [5000] * 600
    x[0] = x[1] = [2.9, 2, 2]
    n[0] = 10
    out = _verdicts(spark, x, n)
    assert 1 in out and 0 not in out


def test_equal_values_and_few_vectors(spark):
    x = np.tile([[1.8, 0.2, 0.9]], (300, 1))
    assert _verdicts(spark, x) == set()  # one distinct vector: not judged
    docs = spark.createDataFrame([(k, "some words in a row " * 2 + f"and number {k} at the end of it all with more of the same kind here", "en", "s") for k in range(8)], "doc_id long, text string, lang string, source string")
    assert {(r.distance, r.kept) for r in quality_rules.judged(docs).collect()} == {(None, True)}
    y = np.hstack([np.random.default_rng(11).normal(2, 0.3, (200, 1)), np.full((200, 2), 0.5)])
    assert len(_verdicts(spark, y)) <= 2  # no variance in two of three


def test_distance_matches_brute_force(spark, documents):
    """The whole of ``judged`` against plain concentration steps over the same bins, in numpy, without any floor."""
    rows = [(r.doc_id, r.lang, r.source, *brute(r.text), r.text or "") for r in documents.collect()]
    names = list(quality_rules.FEATURES)
    good = [r for r in rows if r[3] >= 20 and 100 * r[7] <= 30 * r[3]]
    vector = {}
    for r in good:
        n, chars, text = r[3], r[4], r[8]
        marks = sum(unicodedata.category(c)[0] not in "LMN" and c not in " \t\n\r\x0b\x0c" for c in text)
        vector[r[0]] = (n, np.log1p(chars / n), np.sqrt(marks / n), np.log(len(set(WORDS.findall(text)))) / np.log(n))
    distinct = {(r[1], r[2], *vector[r[0]]) for r in good}
    size, of_lang = Counter(v[:2] for v in distinct), Counter(v[0] for v in distinct)
    least = quality_rules.LEAST
    level = {k: 2 if n >= least else 1 if of_lang[k[0]] >= least else 0 for k, n in size.items()}
    home = lambda r: [(r[1], r[2]), (r[1], "*"), ("*", "*")][2 - level[r[1], r[2]]]
    members = {}
    for v in distinct:
        for group in {("*", "*"), (v[0], "*"), v[:2]}:
            members.setdefault(group, []).append(v[2:])
    want = {}
    for group in {home(r) for r in good}:
        n, x = np.array([v[0] for v in members[group]]), np.array([v[1:] for v in members[group]])
        start = spark.createDataFrame(pd.DataFrame(x, columns=names)).agg(*[F.percentile_approx(a, [0.1587, 0.5, 0.8413], 2000).alias(a) for a in names]).first()
        low, mid, high = np.array([start[a] for a in names]).T
        drawn = lambda x, n: mid + (x - mid) * (n / (n + quality_rules.FEW))  # noqa: B023, E731
        x = drawn(x, n[:, None])
        m, cov, det = mid, np.diag(((high - low) / 2) ** 2), None
        while True:
            y = np.linalg.solve(np.linalg.cholesky(cov), (x - m).T)
            bins = np.floor(np.log2(np.maximum((y**2).sum(0), 2.0**quality_rules.LOW)) * quality_rules.BINS)
            wanted = quality_rules.SHARE * len(x)
            last = next(b for b in np.unique(bins) if (bins <= b).sum() >= wanted)
            weight = np.where(bins < last, 1.0, np.where(bins == last, (wanted - (bins < last).sum()) / (bins == last).sum(), 0.0))
            next_m = (weight[:, None] * x).sum(0) / wanted
            next_cov = ((weight[:, None] * x).T @ x / wanted - np.outer(next_m, next_m)) / quality_rules.SHRINKAGE
            next_det = np.linalg.slogdet(next_cov)[1]
            done = det is not None and next_det >= det - quality_rules.STILL
            if det is None or next_det < det:
                m, cov, det = next_m, next_cov, next_det
            if done:
                break
        for r in good:
            if home(r) == group:
                y = np.linalg.solve(np.linalg.cholesky(cov), drawn(np.array(vector[r[0]][1:]), r[3]) - m)
                want[r[0]] = (y**2).sum()
    got = {r.doc_id: r for r in quality_rules.judged(documents).collect()}
    assert len(want) > 100
    for d, r in got.items():
        assert (r.distance is None) == (d not in want)
        if d in want:
            assert abs(r.distance - want[d]) < 1e-3 * max(1, want[d]), (d, r.distance, want[d])
            assert r.kept == (want[d] <= quality_rules.LIMIT)


def test_groups_vary_and_the_estimates_decide(spark):
    """No variance stands at its floor, and a fixed rule for all groups would judge otherwise."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = quality_rules.text_stats(docs, ["doc_id", "lang", "source"]).withColumns(quality_rules.features()).filter(~quality_rules.base_failed())
    chosen, models = quality_rules.group_models(stats)
    spread = quality_rules._spread(stats.select(*quality_rules.FEATURES))
    rows = models.collect()
    assert len(rows) >= 2 and all(r[f"c_{a}_{a}"] > 100 * quality_rules.SINGULAR * spread[a] for r in rows for a in quality_rules.FEATURES)
    assert max(abs(r["c_f_distinct_f_word"]) / (r["c_f_word_f_word"] * r["c_f_distinct_f_distinct"]) ** 0.5 for r in rows) > 0.02


def test_filter_keeps_rows_and_columns(odd, empty, documents):
    out = quality_rules.quality_filter(odd)
    assert out.columns == odd.columns
    kept = quality_rules.judged(odd).filter("kept").count()
    assert out.count() == kept
    assert quality_rules.quality_filter(empty).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judged(docs).filter("NOT base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
