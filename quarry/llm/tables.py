"""Tables written to the folder that all executors share, and names that clash with no column."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.components import release, shared_checkpoint


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read from there: columns are pruned, lineage is cut.

    `dropped` removes it as soon as no one reads it any more; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    shared_checkpoint(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` gave; others are left alone."""
    for t in tables:
        if path := getattr(t, "_quarry_path", None):
            at, fs = _hadoop(t.sparkSession, path)
            fs.delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front of those that df has a column of already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
