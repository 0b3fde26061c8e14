import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_best_fit(lengths, size):
    """How full the windows get, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= n
        else:
            room.append(size - n)
    return sorted(size - r for r in room)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=80))))
def test_plan_is_best_fit_decreasing(case):
    size, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    windows = {}
    seen = {n: 0 for n in counts}
    for length, rank, n, first, offset in packing.plan_windows(counts, size):
        assert rank == seen[length]
        seen[length] += n
        for k in range(first, first + n):
            windows.setdefault(k, []).append((offset, length))
    assert seen == counts
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(sum(n for _, n in p) for p in windows.values()) == brute_best_fit(lengths, size)
    assert sorted(windows) == list(range(len(windows)))


def test_ids_equal_the_other_library(documents, odd):
    exact = Tokenizer.from_file(PATH)
    texts = [r.text or "" for d in (documents, odd) for r in d.select("text").collect()]
    texts += ["<|endoftext|> in a text", "a b c", "don't  stop\n\n\n now", "x" * 3000, " " * 500]
    for t in texts:
        if len(t) < 400_000:
            assert packing.token_ids(t, PATH).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_both_libraries_serve_any_length(monkeypatch, documents):
    texts = [r.text or "" for r in documents.limit(40).collect()] + ["été \U0001f600 " * 300]
    fast = [packing.token_ids(t, PATH).tolist() for t in texts]
    monkeypatch.setattr(packing, "FAST_UP_TO", 1)
    assert [packing.token_ids(t, PATH).tolist() for t in texts] == fast
    monkeypatch.setattr(packing, "FAST_UP_TO", 1_000_000)
    long_text = "".join(f"w{k % 977} " for k in range(210_000))
    assert len(long_text) > packing.FAST_UP_TO
    assert packing.token_ids(long_text, PATH).tolist()[:50_000] == packing.token_ids(long_text[:300_000], PATH).tolist()[:50_000]


def check(docs, out):
    rows = docs.select("doc_id", "text").collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append(np.append(packing.token_ids(r.text or "", PATH), 1).astype("<u4"))
    sequences, pieces = {}, {}
    for r in out:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, texts in ids.items():
        assert sum(n for _, n in pieces[doc]) == sum(map(len, texts))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_pieces_and_sequences(documents, odd):
    for docs in (documents, odd):
        out = packing.pack(docs, PATH).collect()
        sequences = check(docs, out)
        lengths = [r.length for r in out]
        assert sorted(sum(n for _, n in p) for p in sequences.values()) == brute_best_fit(lengths, 2048)


def test_empty(empty):
    assert packing.pack(empty, PATH).count() == 0
