import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row int, _key double, _id string, _text string, _digest int, _group string, _i int, _g double, _source int, _copy string, spans int, class_id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    long_text = " ".join(f"word{k % 5000}" for k in range(60_000))
    prose = "The quick brown fox jumps over the lazy dog near the old river bank while several quiet birds watch from the tall green trees above them all day"
    rows = [
        (1, prose, "en", "a", 10, "x", 1, 0.5),
        (2, prose, "en", "a", 10, "y", 2, None),
        (3, prose + " today", "en", "a", None, None, None, 1.0),
        (4, "", "en", None, 0, "z", 3, 1.0),
        (5, None, None, None, None, None, None, None),
        (None, "short text", "de", "b", 1, "", 0, 0.0),
        (None, None, None, None, None, None, None, None),
        (6, "été \U0001f600 naïve", "fr", "b", 1, "q", 1, 1.0),
        (7, long_text, "en", "a", 1, "q", 1, 1.0),
        (8, "x" * 20_000, "en", "a", 1, "q", 1, 1.0),
        (9, "same row twice here", "en", "c", 1, "q", 1, 1.0),
        (9, "same row twice here", "en", "c", 1, "q", 1, 1.0),
        (9, "another text under that id", "en", "c", 1, "q", 1, 1.0),
        (10, "\n\n \t\n", "en", "c", 1, "q", 1, 1.0),
    ]
    clashing = ("a", "b", 1, "c", 2, 0.5, 3, "d", 4, None)
    return spark.createDataFrame([(*r, *clashing) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
