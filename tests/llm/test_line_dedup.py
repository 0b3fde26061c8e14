import random

from lodestrata.llm.line_dedup import line_dedup, repeated_windows


def brute(rows):
    """Clean text and lines removed of each row; rows that agree in id and text count once."""
    low = lambda x: (x is not None, x or 0)
    docs, gone, first = sorted({(d, t or "") for d, t in rows}, key=lambda r: (low(r[0]), r[1])), {}, {}
    for doc, text in docs:
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if first.setdefault(w, (doc, text, k)) != (doc, text, k):
                gone.setdefault((doc, text), set()).update((k, k + 1, k + 2))
    out = []
    for doc, text in rows:
        k, kept = -1, []
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                k += 1
                if k in gone.get((doc, text or ""), ()):
                    continue
            kept.append(line)
        out.append((doc, len(gone.get((doc, text or ""), ())), "\n".join(kept) if text is not None else None))
    return out


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup(docs).select("_row.doc_id", "n_removed", "clean_text").collect()
    assert sorted(map(str, ((r.doc_id, r.n_removed, r.clean_text) for r in got))) == sorted(map(str, brute(rows)))
    return got


def test_matches_brute_force(spark, documents, odd, empty):
    check(documents)
    check(odd)
    assert line_dedup(empty).count() == 0


def test_overlaps_runs_and_blank_lines(spark):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " \t", "d"]) for _ in range(rng.randrange(14)))) for k in range(60)]
    rows += [(100, "x\nx\nx\nx\nx"), (101, "p\nq\nr\ns\nt"), (102, "0\np\nq\n\nr\ns\n1"), (103, "x\nx\nx")]
    got = {r.doc_id: r.clean_text for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[100] == "x" and got[102] == "0\n\n1" and got[103] == ""


def test_columns_come_back(odd):
    assert line_dedup(odd).select("_row.*").columns == odd.columns
    assert repeated_windows(odd).columns == ["_id", "_text_hash", "_gone"]
