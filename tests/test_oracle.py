"""Every registered query with SQL against DuckDB, on the small tables."""

import os

import duckdb
import pytest

from quarry.plans import library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_equals_duckdb(spark, con, name):
    assert rows(library.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(library.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    from quarry.sources.shipping import ship

    ship(spark)
    assert library.QUERIES[name](spark, SF).count() > 0
