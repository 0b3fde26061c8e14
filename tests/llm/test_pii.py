import hashlib
import math
import random
import re
from collections import Counter

import pytest

from lodestrata.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    text = text or ""
    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PLAIN.items()) for m in p.finditer(text) if valid(kind, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


HARD = [
    "a@b.c.d, a@b, @b.c x..y@z-.q a@b.c_d@e.f a@b.c@d.e a@@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 999999999999.1.1.1 12.34.56.78",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111111111 378282246310005 4111 1111 1111 1112",
    "+1 (212) 555-0100 +12 +1((((((((( +49 30 1234567890123456 ++1-234-567-8901.",
    "\U0001f600 é a@b.co \U0001f600 10.0.0.1 é 4111111111111111 end +1 212 555 0100",
    "a" * 3000 + "@" + "b." * 2000 + "c", "1" * 5000, "1." * 5000, "+1" + " (" * 4000, "", None,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and Mr. Smith wrote to jane [at] mail [dot] org',
]


def check(docs):
    rows = {}
    for r in docs.select("doc_id", "text").collect():
        rows.setdefault(r.doc_id, []).append(brute(r.text))
    for r in pii.summary(pii.find(docs)).collect():
        wants = [w for w in rows[r.doc_id] if hashlib.sha256(",".join(w).encode()).hexdigest() == r.base_sha256]
        assert wants, r
        want = wants[0]
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(x.startswith(f"{kind}:") for x in want)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == want
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_base_spans_match_plain_patterns(spark, documents, odd):
    check(documents)
    check(odd)
    check(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("a1@.+ -(9%_0\n") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice("01. -+") for _ in range(rng.randrange(60))) for _ in range(3000)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_secrets_are_found_and_plain_words_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got = 0, 0
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pii.find(docs).collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id]):
            want += 1
            got += any(s.kind == "secret" and s.start == m.start(1) and s.end == m.end(1) for s in r.spans)
        for s in r.spans:
            assert s.base or re.search("[0-9]", texts[r.doc_id][s.start : s.end]) or s.kind in ("name", "hidden_email")
    assert want > 5 and got == want


def test_keys_and_passwords_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows, want = [], {}
    for k in range(600):
        words = [word() for _ in range(40)]
        planted = [
            "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
            "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
            f"{rng.randrange(1, 224)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
            f"{word()}.{k}@mail{k % 9}.example.com",
            "",
        ][k % 6]
        words.insert(20, planted)
        text = " ".join(words)
        rows.append((k, text))
        if k % 6 < 3:
            m = re.search(r"(?<=password=)[0-9a-f]{18}|AKIA[0-9A-Z]{16}|(?<=\")[0-9a-f]{40}", text)
            want[k] = m.span()
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any((s.start, s.end) == span for s in found[k]) for k, span in want.items())
    assert not any(found[k] for k in range(5, 600, 6))


def em(patterns):
    """Expectation-maximisation as published, in plain Python: votes -> probability."""
    total = sum(patterns.values())
    held, prior = pii.HELD * total, 0.5
    yes = [list(pii._START_YES) for _ in range(4)]
    no = [list(pii._START_NO) for _ in range(4)]

    def posterior(votes):
        a, b = prior, 1 - prior
        for j, v in enumerate(votes):
            a, b = a * yes[j][v + 1], b * no[j][v + 1]
        return a / (a + b)

    for _ in range(pii.ROUNDS):
        q = {v: n * posterior(v) for v, n in patterns.items()}
        s_yes, s_no = sum(q.values()), total - sum(q.values())
        new_yes = [[(sum(q[v] for v in q if v[j] == k - 1) + pii.SMOOTH + held * pii._START_YES[k]) / (s_yes + 3 * pii.SMOOTH + held) for k in range(3)] for j in range(4)]
        new_no = [[(sum(patterns[v] - q[v] for v in q if v[j] == k - 1) + pii.SMOOTH + held * pii._START_NO[k]) / (s_no + 3 * pii.SMOOTH + held) for k in range(3)] for j in range(4)]
        prior, yes, no = (s_yes + pii.SMOOTH) / (total + 2 * pii.SMOOTH), new_yes, new_no
    return {v: posterior(v) for v in patterns}


def test_added_spans_match_brute_force(spark):
    """EM, the soft labels and the naive Bayes decision of ``find`` against plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.candidates(docs, "doc_id", "text").collect()
    counts = Counter(tuple(s.votes) for r in rows for s in r.spans)
    p = em(counts)
    yes, no, sums = 0.0, 0.0, {}
    for r in rows:
        for s in r.spans:
            q = p[tuple(s.votes)]
            yes, no = yes + q, no + 1 - q
            for t in s.traits:
                a, b = sums.get(t, (0.0, 0.0))
                sums[t] = (a + q, b + 1 - q)
    odds = lambda s: math.log((yes + 1) / (no + 1)) + sum(math.log((sums[t][0] + 1) / (yes + 8)) - math.log((sums[t][1] + 1) / (no + 8)) for t in s.traits)
    want = {r._id: [(s.start, s.end, s.kind) for s in r.spans if s.kind in pii.BASE or odds(s) > 0] for r in rows}
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in pii.find(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 50


def test_reliable_labelers_are_told_from_noise(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = lambda p: (1 if rng.random() < p else -1) * (1 if true else -1)
        rows.append(([vote(0.95), vote(0.9), vote(0.5), vote(0.8)],))
    patterns = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").count().withColumnRenamed("count", "n")
    model = pii.reliabilities(patterns).first()["model"]
    right = [model["yes"][3 * j + 2] for j in range(4)]
    assert abs(model["prior"] - 0.4) < 0.05
    assert right[0] > 0.9 and abs(right[2] - 0.5) < 0.06 and abs(right[3] - 0.8) < 0.05


def test_empty(empty):
    assert pii.find(empty).count() == 0


@pytest.mark.parametrize("digits,good", [("4111111111111111", True), ("4111111111111112", False), ("0", True), ("59", True)])
def test_luhn(spark, digits, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(pii.luhn(F.lit(digits)).alias("x")).first().x == good
