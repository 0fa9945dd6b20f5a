"""Nearest neighbours of a query set: odd vectors and ties against DuckDB, and no table of pairs."""

import math
import os

import duckdb
import pytest

from quarry.plans import library


def plain(rows):
    return sorted((q, c, r, None if d is None else "nan" if math.isnan(d) else d) for q, c, r, d in rows)


def folder(spark, at, vectors):
    frame = spark.createDataFrame([(i, v, i % 10) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    frame.repartition(3).write.parquet(f"{at}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet/*.parquet')")
    return plain(con.execute(library.ORACLES["knn_join"]).fetchall())


def many(n=400):
    """Few directions, many equal vectors, and multiples of each other."""
    return [[float(i % 7 + 1), float(i % 3), 1.0 + (i * i) % 5] for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_knn_join_equals_sql_on_odd_vectors(spark, tmp_path):
    vectors = many()
    vectors[3] = vectors[40] = None
    vectors[60] = vectors[61] = [0.0, 0.0, 0.0]
    want = folder(spark, tmp_path / "a", vectors)
    assert plain(library.knn_join(spark, str(tmp_path / "a")).collect()) == want
    # fewer than k with a distance
    want = folder(spark, tmp_path / "b", [[1.0, 0.0], [0.0, 0.0], None, [1.0, 2.0], None, [0.0, 0.0]])
    assert plain(library.knn_join(spark, str(tmp_path / "b")).collect()) == want


def test_knn_join_makes_no_pairs(spark):
    assert "Join" not in plan(library.knn_join(spark, "/root/testdata/sf0.001"))


def test_ann_makes_no_pairs(spark):
    assert "Join" not in plan(library.ann_ivf(spark, "/root/testdata/sf0.001"))


def test_ann_finds_all_among_equal_vectors(spark, tmp_path):
    vectors = many()
    vectors[7], vectors[11] = None, [0.0, 0.0, 0.0]
    want = folder(spark, tmp_path / "a", vectors)
    assert plain(library.ann_ivf(spark, str(tmp_path / "a")).collect()) == want


pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
