import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from lodestrata.engine import Engine
from lodestrata.sources import pages


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "b/c.pdf", "naïve file.pdf"):
        lines = [json.dumps({"page": k, "text": f"{name} page {k}"}) for k in range(1, 4)]
        (tmp_path / (quote(name, safe="") + pages.SUFFIX)).write_text("\n".join([*lines, "not json", "[1]", json.dumps({"page": "x", "text": None})]))
    (tmp_path / "notes.txt").write_text("left out")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.select("source", "page", "text").collect()), key=repr)


def test_all_documents_are_read(spark, folder):
    df = pages.extracted_pages(spark, str(folder))
    want = [(s, k, f"{s} page {k}") for s in ("a.pdf", "b/c.pdf", "naïve file.pdf") for k in (1, 2, 3)] + [(s, None, None) for s in ("a.pdf", "b/c.pdf", "naïve file.pdf")]
    assert rows(df) == sorted(want, key=repr) == rows(pages.extracted_pages(spark, f"file://{folder}"))
    assert df.rdd.getNumPartitions() == 3


def test_conditions_reach_the_source(spark, folder):
    df = pages.extracted_pages(spark, str(folder))
    one = df.filter((F.col("source") == "b/c.pdf") & F.col("page").isin(1, 3))
    assert rows(one) == [("b/c.pdf", 1, "b/c.pdf page 1"), ("b/c.pdf", 3, "b/c.pdf page 3")]
    assert one.rdd.getNumPartitions() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan extracted_pages" in plan and "b/c.pdf" not in plan and "IN (" not in plan  # nothing but IS NOT NULL is left to Spark
    both = df.filter(F.col("source").isin("a.pdf", "gone.pdf") & (F.col("page") > 1))
    assert rows(both) == [("a.pdf", 2, "a.pdf page 2"), ("a.pdf", 3, "a.pdf page 3")] and both.rdd.getNumPartitions() == 1
    assert df.filter("source = 'gone.pdf'").count() == 0


def test_what_is_taken_and_what_is_left(folder):
    reader = pages.PagesReader(str(folder))
    left = list(reader.pushFilters([In(("source",), ("a.pdf", "b/c.pdf")), EqualTo(("source",), "a.pdf"), GreaterThan(("page",), 1), EqualTo(("page",), 2)]))
    assert left == [GreaterThan(("page",), 1)] and reader.sources == {"a.pdf"} and reader.pages == {2}
    (only,) = reader.partitions()
    assert list(reader.read(only)) == [("a.pdf", 2, "a.pdf page 2")]


def test_lines_over_blocks(tmp_path):
    body = b"one\n" + b"x" * 50 + b"\n\nlast"

    class Stream:
        at = 0

        def read(self, n):
            out = body[self.at : self.at + n]
            self.at += n
            return out

    assert list(pages._lines(Stream(), 7)) == [b"one", b"x" * 50, b"", b"last"]


def test_pages_go_into_the_engine(spark, folder, tmp_path_factory):
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", "u1")
    df = pages.extracted_pages(spark, str(folder)).filter("source = 'a.pdf' AND text IS NOT NULL")
    assert [r.source for r in engine.ingest(df).collect()] == ["a.pdf"]
    assert engine._table("chunks").select("source").distinct().count() == 1
