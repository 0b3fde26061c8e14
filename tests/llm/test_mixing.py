import hashlib
import math
from collections import Counter

from lodestrata.llm import mixing


def draw(mean, u):
    term = total = math.exp(-mean)
    k = 0
    while total <= u:
        k += 1
        term *= mean / k
        total += term
    return k


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_counts_match_brute_force(documents):
    rows = documents.select("doc_id", "source").collect()
    n = Counter(r.source for r in rows)
    for weights in (None, {"src0": 3.0, "src1": 1.0, "absent": 9.0}):
        w = {s: math.sqrt(c) if weights is None else weights.get(s, 0.0) for s, c in n.items()}
        means = {s: round(len(rows) * w[s] / sum(w.values()) / n[s], 12) for s in n}
        want = {r.doc_id: draw(means[r.source], unit(f"mix-1:{r.doc_id}:1")) if means[r.source] else 0 for r in rows}
        out = mixing.mix(documents, weights).select("_row.doc_id", "_copy", "_place").collect()
        assert Counter(r.doc_id for r in out) == Counter({d: c for d, c in want.items() if c})
        assert [r._place for r in out] == sorted(r._place for r in out)


def test_large_means_are_split(spark):
    docs = spark.createDataFrame([(k, "rare" if k < 5 else "common") for k in range(2000)], "doc_id long, source string")
    out = mixing.mix(docs, {"rare": 1.0, "common": 1.0}, shuffle=False).groupBy("_row.source").count().collect()
    got = {r.source: r["count"] for r in out}
    # a mean of 200 for each rare row, about 1 row for each common one
    assert abs(got["rare"] - 1000) < 150 and abs(got["common"] - 1000) < 150
    big = mixing.mix(docs.limit(2000), {"rare": 999.0, "common": 1.0}, shuffle=False).groupBy("_row.source").count().collect()
    assert abs({r.source: r["count"] for r in big}["rare"] - 1998) < 200


def test_odd_rows(odd, empty):
    out = mixing.mixed(odd, temperature=1.0)
    assert out.columns == odd.columns
    # every source keeps its share, so the mean is 1 and null sources are drawn as well
    assert out.count() > 0
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd, weights={}).count() == 0
