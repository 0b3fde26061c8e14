import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup
from lodestrata.llm.exact_dedup import cut_points, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    low = lambda x: (x is not None, x or 0)
    return sorted((str(d), str(max(groups[t or ""], key=low)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


def test_matches_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = exact_groups(docs).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(rows)
        assert sum(r.kept for r in got) == len({t or "" for _, t in rows})


def test_stage_keeps_one_row_a_text_and_its_columns(odd):
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_empty(empty):
    assert exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).columns == empty.columns


def test_names_that_contents_share_are_told_apart(spark, monkeypatch):
    class OneName:
        @staticmethod
        def xxh3_128_digest(data):
            return b"n" * 16

    rows = [(1, "a" * 100), (2, "b" * 100), (3, "a" * 100), (4, "b" * 99), (5, "")]
    monkeypatch.setattr(exact_dedup, "xxhash", OneName)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real_names, real_bytes = exact_dedup.chunk_names, exact_dedup.chunk_bytes
    # workers import the module anew, so the single name is sent along
    monkeypatch.setattr(exact_dedup, "chunk_names", _with_one_name(real_names))
    monkeypatch.setattr(exact_dedup, "chunk_bytes", _with_one_name(real_bytes))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(docs).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def _with_one_name(f):
    name = f.__name__

    def run(batches):
        from lodestrata.llm import exact_dedup as module

        class OneName:
            @staticmethod
            def xxh3_128_digest(data):
                return b"n" * 16

        kept = module.xxhash
        module.xxhash = OneName
        try:
            yield from module._chunked(batches, name == "chunk_bytes")
        finally:
            module.xxhash = kept

    return run


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=5000), min_size=1, max_size=4), st.binary(max_size=3000))
def test_cuts_depend_on_the_text_alone(texts, other):
    def cuts(parts):
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return cut_points(np.frombuffer(b"".join(parts), np.uint8), at, least=64, most=1024, bits=6)

    assert cuts([other, *texts])[1:] == cuts(texts)
    for text, ends in zip(texts, cuts(texts), strict=True):
        assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))
        assert all(b - a <= 1024 for a, b in zip([0, *ends], ends, strict=False))
