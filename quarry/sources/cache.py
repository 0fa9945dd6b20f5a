"""The embedding cache: an append-only Parquet log of (hash, vector, created_at), shared by all calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import CacheConfig
from quarry.functions.text import content_hash
from quarry.operators.embedding import put

ENTRY = "hash string, vector array<float>, created_at timestamp"


class EmbeddingCache:
    def __init__(self, spark: SparkSession, path: str, config: CacheConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or CacheConfig()

    def entries(self) -> DataFrame:
        """The entries that haven't expired; a hash may have several."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], ENTRY)
        live = F.col("created_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.config.ttl_seconds))
        return self.spark.read.schema(ENTRY).parquet(self.path).filter(live)

    def read(self) -> DataFrame:
        """(hash, vector), one row a hash."""
        return put(self.entries().limit(0), self.entries())

    def fill(self, texts: DataFrame, embed: Callable[[Column | str], Column], text: str = "text") -> None:
        """Embeds every distinct text that is missing, once, and appends it; only (hash, text) of those travels."""
        missing = texts.select(content_hash(text).alias("hash"), F.col(text).alias("_t")).join(self.entries().select("hash"), "hash", "left_anti")
        fresh = missing.groupBy("hash").agg(F.min("_t").alias("_t")).select("hash", embed("_t").alias("vector"), F.current_timestamp().alias("created_at"))
        fresh.write.mode("append").parquet(self.path)

    def trim(self, path: str) -> EmbeddingCache:
        """A cache at another path with the newest `max_entries` entries of this one."""
        newest = self.entries().groupBy("hash").agg(F.max("created_at").alias("created_at"), F.max_by("vector", "created_at").alias("vector"))
        newest.orderBy(F.desc("created_at"), "hash").limit(self.config.max_entries).select("hash", "vector", "created_at").write.parquet(path)
        return EmbeddingCache(self.spark, path, self.config)
