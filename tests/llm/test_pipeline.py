"""The pipeline's stages on planted cases, and the registered queries with SQL."""

import os
from collections import defaultdict

import pytest
from brute import components, shingles
from test_operators import R, edited, frame, prose

from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    item = prose(30)
    texts = [prose(R.randint(60, 200)) + f"\nline of everyone\n{prose(20)}" for i in range(60)]
    texts += [edited(texts[i].replace("\nline of everyone\n", " "), 0.004) for i in range(10)]
    texts += [prose(40) + " " + item + " " + prose(40)] + ["12345 ...", None, ""]
    frame(spark, texts, source=lambda i: f"s{i % 15}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_by_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in out[name]}
    assert ids("language") == set(range(71))
    lines = {r["doc_id"]: r["text"] for r in out["lines"]}
    assert set(lines) == set(range(71)) and sum("line of everyone" in t for t in lines.values()) == 1
    group = components({i: shingles(t) for i, t in lines.items()})
    assert ids("near_duplicates") == set(group.values())
    assert ids("decontaminate") == ids("near_duplicates") - {70}
    copies = defaultdict(list)
    for r in out["mix"]:
        copies[r["doc_id"]].append(r["copy_no"])
    assert set(copies) <= ids("decontaminate") and all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(r.asDict()) == columns for name in list(out)[:-1] for r in out[name])
    # run() gives the stages' rows
    assert sorted((r["doc_id"], r["copy_no"]) for r in P.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["copy_no"]) for r in out["mix"])


def test_repeated_rows_stay_once(spark, sf_dir):
    docs = frame(spark, [prose(30), prose(40)])
    twice = docs.union(docs)
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, twice, sf_dir).collect()) == [0, 1]
    # unlike texts of one doc_id, rows without a word or an id, and a column with an odd name
    unlike = frame(spark, [prose(30), prose(40), "", None]).withColumns({"doc_id": F.lit(5).cast("long"), "near_id": F.lit("c")})
    nameless = frame(spark, [prose(30)] * 2).withColumns({"doc_id": F.lit(None).cast("long"), "near_id": F.lit("c")})
    out = P.near_duplicates(spark, unlike.union(unlike.limit(1)).union(nameless), sf_dir)
    assert out.count() == 6 and out.columns == unlike.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns)
    rows = lambda f: sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in f[names].itertuples(index=False)), key=repr)
    assert rows(mine) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_over_the_whole_table(spark, name):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = registry.queries()[name](spark, SF).count()
    assert rows == n or name == "op1_substring_dedup"
