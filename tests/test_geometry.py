from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import geometry

SPANS = "page int, x0 double, y0 double, x1 double, y1 double, text string"


def spans(spark, rows):
    return spark.createDataFrame([(p, float(a), float(b), float(c), float(d), t) for p, a, b, c, d, t in rows], SPANS)


def test_borderless_table(spark):
    rows = [(1, 0, 0, 30, 10, "Code"), (1, 50, 1, 90, 11, "Meaning"), (1, 0, 11, 25, 21, "E-01"), (1, 50, 11, 70, 21, "Door"), (1, 73, 11, 95, 21, "open"), (1, 2, 22, 25, 32, "E-02"), (1, 60, 33, 80, 43, "second"), (1, 40, 0, 44, 10, " "), (2, 0, 0, 5, 5, "x")]
    got = {(r.page, r.row_no, r.col_no): r.text for r in geometry.grid(spans(spark, rows), ["page"]).collect()}
    assert got == {(1, 0, 0): "Code", (1, 0, 1): "Meaning", (1, 1, 0): "E-01", (1, 1, 1): "Door open", (1, 2, 0): "E-02", (1, 3, 1): "second", (2, 0, 0): "x"}


ROWS = "page int, table_no int, row_no int, y0 double, y1 double, cells array<string>"
RECTS = "page int, table_no int, x0 double, y0 double, x1 double, y1 double"


def lost(spark, rows, beside, rect=(1, 1, 0.0, 0.0, 100.0, 40.0)):
    df = spark.createDataFrame([(1, 1, k, 10.0 * k, 10.0 * k + 10, c) for k, c in enumerate(rows)], ROWS)
    out = geometry.recovered(df, spans(spark, beside), spark.createDataFrame([rect], RECTS), ["page"]).orderBy("row_no").collect()
    return [r.cells for r in out], {r.repaired for r in out}


def test_lost_columns_come_back(spark):
    rows = [["Name"], ["Ann"], [""], ["Bob"]]
    left = [(1, -40, 1, -5, 9, "Id"), (1, -40, 11, -20, 19, "EMP"), (1, -18, 11, -5, 19, "1"), (1, -40, 31, -5, 39, "EMP 2")]
    right = [(1, 110, 0, 120, 10, "Note"), (1, 110, 10, 120, 20, "a"), (1, 110, 30, 120, 40, "b")]
    other = [(1, 10, 1, 20, 9, "inside"), (1, 110, 60, 120, 70, "below"), (2, 110, 0, 120, 10, "another page")]
    assert lost(spark, rows, left + other) == ([["Id", "Name"], ["EMP 1", "Ann"], ["", ""], ["EMP 2", "Bob"]], {True})
    assert lost(spark, rows, left + right) == ([["Id", "Name", "Note"], ["EMP 1", "Ann", "a"], ["", "", ""], ["EMP 2", "Bob", "b"]], {True})
    assert lost(spark, rows, other) == (rows, {False})


def test_a_side_is_not_believed_in_part(spark):
    rows = [["Name"], ["Ann"], ["Bob"]]
    assert lost(spark, rows, [(1, -40, 1, -5, 9, "Id"), (1, -40, 11, -5, 19, "1")]) == (rows, {False})  # Bob has none
    assert lost(spark, rows, [(1, -40, 11, -5, 19, "1"), (1, -40, 21, -5, 29, "2")]) == (rows, {False})  # no header


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), min_size=1, max_size=12), st.integers(0, 3))
def test_groups_of_intervals(spark, values, gap):
    df = spark.createDataFrame([(1, float(a), float(a + n)) for a, n in values], "page int, a double, b double")
    got = sorted((r.a, r.b, r.g) for r in geometry.intervals(df, ["page"], "a", "b", "g", gap).collect())
    group, end, want = -1, None, []
    for a, b in sorted((float(a), float(a + n)) for a, n in values):
        if end is None or a > end + gap:
            group += 1
        end = b if end is None else max(end, b)
        want.append((a, b, group))
    assert got == sorted(want)
