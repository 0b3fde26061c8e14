import math
from collections import Counter

import corpus_pipeline
from lodestrata.llm import quality_rules
from tests.llm.test_minhash_dedup import classes
from tests.llm.test_mixing import draw, unit
from tests.llm.test_packing import PATH, packing


def test_stages_match_brute_force(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    last = {}
    for r in rows:
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    rows = [r for r in rows if last[r.text] == r.doc_id]
    firsts = {c for _, c, _ in classes([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in firsts]
    n = Counter(r.source for r in rows)
    total = sum(map(math.sqrt, n.values()))
    mean = {s: round(len(rows) * math.sqrt(c) / total / c, 12) for s, c in n.items()}
    want = Counter({r.doc_id: k for r in rows if (k := draw(mean[r.source], unit(f"mix-1:{r.doc_id}:1")))})
    size = {r.doc_id: len(packing.token_ids(r.text, PATH)) + 1 for r in rows}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter(r.doc_id for r in out if r.start == 0) == want
    assert sum(r.length for r in out) == sum(size[d] * k for d, k in want.items())
    filled = Counter()
    for r in out:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_stages_give_the_columns_of_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash_dedup", "mixing", "packing"]
