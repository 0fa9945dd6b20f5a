import pytest

from brute import DOC

from quarry.sources.shipping import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)





@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with names that clash."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 44),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 44),
        (2, "", "en", "s1", 0),
        (3, None, "en", "s2", None),
        (4, " \t\n\x0b ", None, None, 5),
        (None, "a text without an id goes along too", "fr", "s2", None),
        (6, "word " * 30_000, "de", "s3", None),
        (7, "x" * 50_000, None, "s3", None),
        (8, "one two", "en", "s1", 7),
        (9, "ünï çødé 中文 😀 !!! ###", "fr", None, 1),
    ]
    frame = spark.createDataFrame(rows, DOC)
    for name in ("doc", "a", "b", "key", "h", "score", "start", "line", "item_id", "n", "row_id", "hash", "copy_no", "n_removed_lines", "lang_pred"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
