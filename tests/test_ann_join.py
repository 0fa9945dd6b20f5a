"""The registered approximate index against the exact search."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans import library

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_index_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = {(r["query_id"], r["chunk_id"]) for r in search.knn_join(rows, queries, 5).collect()}
    got = {(r["query_id"], r["chunk_id"]) for r in library.ann_ivf(spark, SF).collect()}
    print("RECALL", len(want & got) / len(want), len(got), len(want))
    assert len(got) == len(want) and len(want & got) >= 0.9 * len(want)
