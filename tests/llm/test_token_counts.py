import json
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)
COUNTER = token_counts.counter(PATH)


def library(text):
    return len(EXACT.encode(text, add_special_tokens=False).ids)


def brute_merges(symbols, ranks):
    """Look at all pairs again before each merge."""
    at, merges = list(symbols), 0
    while True:
        known = [(ranks[p], k) for k, p in enumerate(zip(at, at[1:])) if p in ranks]
        if not known:
            return merges
        _, k = min(known)
        at[k : k + 2] = [at[k] + at[k + 1]]
        merges += 1


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=40), st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.text("abc", min_size=1, max_size=3)), max_size=25, unique=True))
def test_merges_equal_brute_force(symbols, pairs):
    ranks = {p: k for k, p in enumerate(pairs)}
    assert token_counts.merge_count(symbols, ranks) == brute_merges(symbols, ranks)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 's\n\t.1 \U0001f600é中")), max_size=200))
def test_any_text_counts_as_in_the_library(text):
    assert COUNTER.tokens(text) == library(text)


def test_every_character_counts_as_in_the_library():
    """Letters, numbers and spaces of any version of Unicode, each beside others: the planes that have any."""
    for low in range(0, 0x20000, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}\n" for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        assert COUNTER.tokens(text) == library(text)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext|", "don't  stop\n\n\n now ", " " * 5000, "x" * 5000, "7" * 3001, "\n" * 999, "'s'll'", "\U0001f468‍\U0001f469‍\U0001f467"])
def test_special_and_repeated(text):
    assert COUNTER.tokens(text) == library(text)


def test_segments_give_the_same_counts(monkeypatch, documents):
    texts = [r.text or "" for r in documents.limit(60).collect()] + ["été 中文, 'tis  the\n\n 3.14 one's", "a 'b 'c 's 't"]
    want = [library(t) for t in texts]
    for size in (1, 3, 50):
        monkeypatch.setattr(token_counts, "SEGMENT", size)
        assert [COUNTER.tokens(t) for t in texts] == want


def test_one_very_long_run_takes_log_linear_time():
    text = "ab" * 150_000
    start = time.time()
    assert COUNTER.tokens(text) == library(text)
    assert time.time() - start < 20


def test_table_against_the_library(documents, odd):
    for docs in (documents, odd):
        got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=repr)
        want = [(r.doc_id, len((r.text or "").encode()), library(r.text or ""), library(r.text or "") > 512) for r in docs.select("doc_id", "text").collect()]
        assert got == sorted(want, key=repr)
    assert {r.n_tokens for r in token_counts.count_tokens(odd.filter("doc_id in (4, 5)"), PATH).collect()} == {0}


def test_empty_table_and_limit(empty, documents):
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = token_counts.count_tokens(documents, PATH, limit=10).collect()
    assert all(r.over_limit == (r.n_tokens > 10) for r in rows)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.Counter(str(tmp_path / "v.json"))
