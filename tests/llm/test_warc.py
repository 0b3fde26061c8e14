import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import warc
from lodestrata.llm.common import shared_dir


def rows_of(spark):
    return [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a/3 x%20\r\nq", "<p>one</p>"), (4, None, None), (5, "", ""), (None, "http://n", "<p>two</p>"), (6, "http://é", "é \U0001f600\r\n\r\n" * 5), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (8, "big", "z" * 300_000)]


def brute(rows):
    low = lambda x: (x is not None, x or 0)
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        first[body] = min([key, *([first[body]] if body in first else [])], key=low)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        revisit = key != first[body]
        out.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[body] if revisit else None))
    return out


def test_round_trip(spark):
    rows = rows_of(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(brute(rows), key=key)


def test_payloads_urls_and_selection_by_index(spark):
    rows = rows_of(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"{shared_dir(spark)}/warc"
    index = warc.write_archives(pages, folder, archive_bytes=300)
    assert index.select("archive").distinct().count() > 2
    assert index.columns[:5] == ["archive", "offset", "length", "url", "digest"]
    chosen = index.filter("page_id IN (1, 6, 8)")
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_records(chosen, folder).collect()}
    assert got == {k: (u, h) for k, u, h in rows if k in (1, 6, 8)}
    urls = {r.page_id: r.url for r in warc.read_records(index, folder).collect()}
    assert urls[3] == "http://a/3 x%20\r\nq" and urls[4] is None


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    got = warc.round_trip(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == sorted(x[:4] for x in brute(rows))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, offset long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.binary(max_size=200), st.booleans())
def test_record_parses_back(url, payload, revisit):
    member, digest = warc.record(5, url, payload, 3, revisit)
    got = warc.parse(member)
    assert got["headers"]["WARC-Payload-Digest"] == f"sha1:{digest}"
    assert got["payload"] == (b"" if revisit else payload)
    assert int(got["http"]["Content-Length"]) == len(payload)
    assert not url or warc.unquote(got["headers"]["WARC-Target-URI"]) == url
