"""Connected components of a table of links, without collecting any of it.

Alternates the large-star and small-star steps: each replaces links by links to
the smallest neighbour until every member points at its component's smallest id.
A star's minimum is a partial aggregate and the links are joined back to it, so a
hub's links are never gathered in one task.  Rounds are cut with checkpoint().
"""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoint(spark: SparkSession) -> None:
    """Checkpoints go where the session says; a folder of our own only where nothing is set (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_checkpoint(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been cut off: it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) for every id in links (a, b) other than a root: root is the smallest id it reaches."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            release(links.sparkSession)
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").union(low).distinct()
        edges = cut(small)
    raise RuntimeError("components did not settle")
