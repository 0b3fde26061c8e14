import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import alignment, common

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


def byte_of_letter():
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173) and not 127 <= b <= 160]
    other = iter(range(256, 512))
    return {(chr(b) if b in plain else chr(next(other))): b for b in range(256)}


def brute(texts):
    """All token pairs of each text by their byte ranges, one at a time."""
    one, two, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of_letter()
    one.encode_special_tokens = True
    found = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        bytes_a = [bytes(letters[c] for c in one.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [two.id_to_piece(x)]]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([x for x, e in zip(a, ends_a) if low < e <= end], [x for x, e in zip(b, ends_b) if low < e <= end]))
            low = end
        found.append((len(a), len(b), groups, [(x, y) for p, q in groups for x in p for y in q]))
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for f in found:
        if f is None:
            rows.append(EMPTY)
            continue
        n_a, n_b, groups, links = f
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(written.encode()).hexdigest()))
    return rows


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]), strict=True)]
    got = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_small_table_equals_brute_force(spark):
    texts = ["hello world", "hello world", " two  spaces\n\nand lines\t", "été 中文 \U0001f600", "<|endoftext|> </s> <0x41> ▁", "x" * 300, "0123456789" * 20, "", None, "a▁b", "end ", "don't", "\x00\x01", "ﬁ ① Å"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_documents_equal_brute_force(spark, documents):
    check(spark.createDataFrame(documents.limit(60).collect(), documents.schema).repartition(3))


def test_defined_cases(odd, empty):
    got = check(odd.filter("doc_id <> 7 or doc_id is null"))
    assert (4, *EMPTY) in got and (None, *EMPTY) in got
    assert alignment.align(empty, A, B).count() == 0
    (long,) = alignment.align(odd.filter("doc_id = 7"), A, B).collect()
    assert long.n_a > 60_000 and long.n_best <= long.n_links


def test_blocks_and_hot_pairs_change_nothing(spark, documents, monkeypatch):
    docs = spark.createDataFrame(documents.limit(40).collect(), documents.schema)
    want = sorted(map(tuple, alignment.align(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "BLOCK", 2000)
    assert sorted(map(tuple, alignment.align(docs.repartition(5), A, B).collect())) == want
    monkeypatch.setattr(common.looked_up, "__defaults__", (3,))
    assert sorted(map(tuple, alignment.align(docs.repartition(5), A, B).collect())) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, alignment.align(docs.repartition(5), A, B).collect())) == want


def test_a_block_is_handed_on_in_short_rows(documents):
    texts = [r.text or "" for r in documents.select("text").collect()]
    texts *= alignment.BLOCK // sum(map(len, texts)) + 1
    alignment.aligner(A, B)
    batch = pa.RecordBatch.from_pydict({"_id": list(range(len(texts))), "_text": texts, "_key": list(range(len(texts)))})
    tracemalloc.start()
    try:
        rows = [(out.num_rows, out.nbytes) for out in alignment._aligned(A, B)([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(size / n for n, size in rows) < 1 << 16
    assert peak < 100e6


def test_answers_come_in_pieces(spark, documents):
    docs = spark.createDataFrame(documents.limit(30).collect(), documents.schema).repartition(3)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        check(docs)
    finally:
        spark.conf.set(setting, before)


def test_many_pairs_and_many_times(spark):
    """Places and numbers that take more bytes than those of other blocks do."""
    letters = np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz"), (4000, 25, 14))
    texts = [" ".join(map("".join, words)) for words in letters] + ["the " * 700, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert alignment.blocks(docs, A, B).agg(F.max("_place")).first()[0] > 1 << 16
    check(docs)


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "hello hello"), (2, "hello"), (3, "world")], "doc_id long, text string")
    rows = alignment.pair_counts(alignment.blocks(docs, A, B)).collect()
    assert {r.n_docs for r in rows} == {1, 2} and all(r.best for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.lists(st.integers(1, 4), min_size=1, max_size=4)), min_size=1, max_size=8))
def test_links_of_groups(groups):
    ga = np.repeat(np.arange(len(groups)), [len(a) for a, _ in groups])
    gb = np.repeat(np.arange(len(groups)), [len(b) for _, b in groups])
    got = alignment.links(ga, np.concatenate([a for a, _ in groups]), gb, np.concatenate([b for _, b in groups]))
    want = Counter((g, (x << alignment.SHIFT) + y) for g, (a, b) in enumerate(groups) for x in a for y in b)
    assert {(int(g), int(p)): int(n) for g, p, n in zip(*got)} == want


def test_both_libraries_of_a_agree():
    """Every character beside others; the check that lets the faster library stand in."""
    both = alignment.aligner(A, B)
    for low in range(0, 0x110000, 2048):
        text = "".join(f" a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}\n" for c in range(low, low + 2048) if not 0xD800 <= c < 0xE000)
        assert both.ids_a(text).tolist() == both.exact.encode(text, add_special_tokens=False).ids, hex(low)


def test_label_string():
    assert alignment.labels(np.array([2, 5, 6]), np.array([1, 5, 6])) == b"ba..||"
    assert alignment.group_sizes(b"ba..||").tolist() == [[2, 2], [1, 1]]
