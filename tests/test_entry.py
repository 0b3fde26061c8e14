import importlib
import sys

import __spark_entry__


def test_entry_point(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.verdict == "confident" and "Account balance" in row.fact


def test_other_queries_work_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lodestrata.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestrata.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert "fact_max" in bare.queries() and not any(q.startswith("op") or q == "pipeline" for q in bare.queries())
    assert set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
