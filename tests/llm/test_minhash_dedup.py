import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import common, minhash_dedup
from lodestrata.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def multiset(text):
    w = WORDS.findall(text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())


def classes(rows):
    """Class of each row as the least id, by trying all pairs."""
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    sets = [multiset(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        if find(a) != find(b) and (same or (sets[a].keys() & sets[b].keys() and similarity(sets[a], sets[b]) >= 0.8)):
            label[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    low = lambda x: (x is not None, x or 0)
    return [(rows[k][0], min(groups[find(k)], key=low), len(groups[find(k)])) for k in range(len(rows))]


def near_rows():
    """Families of near copies, some linked only through a third text."""
    rng = random.Random(4)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(text)))
            if family % 3 == 0:
                base = text
    return rows


def test_classes_match_all_pairs(spark, odd):
    small = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 10_000]
    for rows in (near_rows(), small):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = minhash_dedup.near_groups(docs).collect()
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=key) == sorted(classes(rows), key=key)


def test_large_buckets_of_unlike_members(spark, monkeypatch):
    """Copies of one text with more or fewer edits: linked to the leader, to each other only, or to nothing."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(170)]
    rows = []
    for family in range(7):
        edits = {rng.randrange(170): f"f{family}-{k}" for k in range(8)}
        for _ in range(5):
            text = list(base)
            for at, word in list(edits.items())[: rng.choice([3, 5, 7, 8])]:
                text[at] = word
            if rng.random() < 0.5:
                text[rng.randrange(170)] = f"own{len(rows)}"
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + k, " ".join(base[: 170 - k])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(classes(rows))


def test_one_document_of_each_class_stays(spark, odd, empty):
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    groups = minhash_dedup.near_groups(docs)
    assert minhash_dedup.near_dedup(docs).count() == groups.select("class_id").distinct().count()
    out = minhash_dedup.near_dedup(odd)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert minhash_dedup.near_dedup(empty).count() == 0


def test_slices_of_a_few_words(spark):
    """Tables, and slices of them, that hold 0 to 6 words in total."""
    for n in range(7):
        text = " ".join("abcdef"[:n])
        data, at = common.text_bytes(pa.array([text]))
        row, _, count = common.shingles(data, at)
        assert len(row) == count.sum() == (1 if n else 0) + max(0, n - 5)
    rows = [(k, " ".join("abcdef"[:k])) for k in range(7)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "a b")], "doc_id long, text string")):
        got = minhash_dedup.near_groups(docs).collect()
        assert all(r.class_size == 1 and r.kept for r in got)


def test_long_words_that_swap_blocks_differ(spark):
    x, y = "x" * 1023 + "a", "y" * 1023 + "b"
    _, word = common.words(*common.text_bytes(pa.array([x + y, y + x, x + y])))
    assert word[0] != word[1] and word[0] == word[2]
    docs = spark.createDataFrame([(1, x + y), (2, y + x)], "doc_id long, text string")
    assert {r.class_size for r in minhash_dedup.near_groups(docs).collect()} == {1}


def test_links_are_checked_on_words():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(2))
        b = a if rng.random() < 0.2 else b
        assert abs(minhash_dedup.exact_jaccard(a.encode(), b.encode()) - similarity(multiset(a), multiset(b))) < 1e-9


def test_a_large_bucket_below_the_limit(spark, monkeypatch):
    """Many texts 0.75 to 0.8 alike in one bucket, a few links among them, over several splits."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 3)
    monkeypatch.setattr(minhash_dedup, "GROWTH", 2)
    monkeypatch.setattr(minhash_dedup, "SAMPLE", 6)
    rng = random.Random(21)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(60):
        text = list(base)
        for j in range(rng.choice([3, 4, 5])):
            text[rng.randrange(200)] = f"n{k}-{j}"
        rows.append((k, " ".join(text)))
        if k % 6 == 0:
            text[rng.randrange(200)] = "once"
            rows.append((100 + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_groups(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(classes(rows))


def test_members_of_a_family_are_split_once(spark, monkeypatch):
    """Buckets that overlap are split by one head, not each by its own leader."""
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(150):
        text = list(base)
        for j in range(rng.choice([2, 3, 4, 5])):
            text[rng.randrange(200)] = f"n{k}-{j}"
        rows.append((k, " ".join(text)))
    split, met = minhash_dedup._Settling.split, []

    def counted(self, many):
        met.append((many.count(), many.select("b").distinct().count()))
        return split(self, many)

    monkeypatch.setattr(minhash_dedup._Settling, "split", counted)
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(classes(rows))
    assert met and all(pairs <= 1.5 * members for pairs, members in met), met


def test_a_family_is_led_by_the_text_it_copies(spark, monkeypatch):
    """Copies of one text with few to many edits, a shorter one among them: the text itself leads, so little is left open."""
    rng = random.Random(8)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(300):
        text = list(base)
        for j in range(1 + min(rng.randrange(12), rng.randrange(12))):
            text[rng.randrange(150)] = f"n{k}-{j}" if rng.random() < 0.7 else f"often{rng.randrange(40)}"
        rows.append((k, " ".join(text)))
    rows += [(300, " ".join(base)), (301, " ".join(base[:147]))]
    linked, met = minhash_dedup._Settling.linked, []

    def counted(self, labels, pairs):
        met.append(pairs.count())
        return linked(self, labels, pairs)

    monkeypatch.setattr(minhash_dedup._Settling, "linked", counted)
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(classes(rows))
    # what the family's leader leaves open once all have met it
    assert sum(met[2:]) <= len(rows) / 2, met


def test_texts_smaller_than_their_leader(spark, monkeypatch):
    """Links of texts that the leader misses to smaller ones, which may share nothing outside it."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 2)
    monkeypatch.setattr(minhash_dedup, "GROWTH", 6)
    rng = random.Random(31)
    base, rows = [f"w{k}" for k in range(100)], []
    for k in range(40):
        text = list(base)
        for j in range(rng.choice([0, 1, 2, 2, 3, 3])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1, 3])] = [f"n{k}-{j}"] * rng.choice([0, 1, 1, 2])
        low = rng.choice([0, 0, 4, 8])
        rows.append((k, " ".join(text[low : len(text) - rng.choice([0, 0, 6, 12])])))
    different, by_size = minhash_dedup._Settling.different, []

    def counted(self, buckets):
        by_size.append(buckets.filter("by_size").count())
        return different(self, buckets)

    monkeypatch.setattr(minhash_dedup._Settling, "different", counted)
    got = minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == sorted(classes(rows))
    assert any(by_size), by_size


def test_other_thresholds_are_refused(documents):
    with pytest.raises(ValueError):
        minhash_dedup.near_groups(documents, similar=0.5)


def test_rows_that_share_an_id_keep_one_of_each_class(spark):
    rows = [(9, "one two three four five six"), (9, "quite another text of some more words"), (9, "one two three four five six"), (10, "quite another text of some more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in minhash_dedup.near_dedup(docs).collect()) == sorted({t for _, t in rows})


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist())
        b = Counter(rng.integers(0, 12, rng.integers(1, 30)).tolist())
        xa, xb = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
        got = minhash_dedup.weighted_jaccard(xa, np.array([a[int(k)] for k in xa]), xb, np.array([b[int(k)] for k in xb]))
        want = similarity(a, b)
        assert abs(got - want) < 1e-9 or want <= got < 0.5  # far apart, a bound will do
        assert probability_jaccard(a, b) >= want - 1e-9


def test_signatures_estimate_similarity():
    a, b = {k: 1 + k % 3 for k in range(60)}, {k: 1 + k % 3 for k in range(15, 75)}
    want = probability_jaccard(Counter(a), Counter(b))
    row = np.repeat([0, 1], 60)
    item = common.mix64(np.array([*a, *b], np.uint64))
    sign = minhash_dedup.prob_minhash(row, item, np.array([*a.values(), *b.values()], float), 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - want) < 0.03
    assert len(set(sign[0].tolist())) > 40  # no shingle left out


def test_words_of_slices_are_those_of_the_whole():
    texts = ["", "a", "a  b\nc", None, "é ü " * 400, "x" * 5000, "tail"]
    data, at = common.text_bytes(pa.array(texts))
    row, word = common.words(data, at)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    kept = common.SEGMENT
    try:
        common.SEGMENT = 16
        again = common.words(data, at)
    finally:
        common.SEGMENT = kept
    assert row.tolist() == again[0].tolist() and word.tolist() == again[1].tolist()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
