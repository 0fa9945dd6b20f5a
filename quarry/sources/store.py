"""The chunk store: an append-only Parquet log of file versions, partitioned by user.

An upsert or a delete of a file appends rows with a higher version; a reader takes the highest version
of every (user_id, file_id).  Nothing is rewritten, so a replayed batch gives the same rows, and a reader of one
user reads one partition.  `compact` writes the live rows as a new log.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import index_name
from quarry.sources.terms import TermIndex

COLUMNS = "file_id string, file_name string, chunk_id string, chunk_index int, content string, vector array<float>, version long, deleted boolean, user_id long"
SCHEMA_VERSION = 2


def latest(rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The rows of the highest version of every key.  The versions are few against the rows."""
    top = rows.groupBy(*keys).agg(F.max(version).alias("_top"))
    on = [rows[k].eqNullSafe(top[k]) for k in keys] + [rows[version] == top["_top"]]
    return rows.join(top, on, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new in place of the rows of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_files(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    return rows.join(files.select(key).distinct(), key, "left_anti")


class ChunkStore(ABC):
    @abstractmethod
    def upsert(self, chunks: DataFrame) -> int: ...

    @abstractmethod
    def delete(self, user_id: int, file_id: str) -> int: ...

    @abstractmethod
    def read(self, user_id: int | None = None) -> DataFrame: ...


class ParquetChunkStore(ChunkStore):
    def __init__(self, spark: SparkSession, path: str, algorithm: str = "FLAT", dimension: int = 0):
        self.spark, self.path = spark, path
        self.algorithm, self.dimension = algorithm, dimension
        self.terms = TermIndex(self)

    # what the store looks like, in a small table beside the log
    def _meta(self) -> DataFrame | None:
        return self._table(f"{self.path}/_meta_schema", "index string, version int, algorithm string, dimension int, location string, created_at timestamp")

    def _table(self, path: str, schema: str) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(schema).parquet(path)

    def ensure(self, user_id: int) -> None:
        """Writes the user's index description once."""
        self.ensure_all(self.spark.createDataFrame([(user_id,)], "user_id long"))

    def ensure_all(self, rows: DataFrame) -> None:
        """Writes the index descriptions that the users among rows (user_id) lack, in one job."""
        names = rows.select(index_name("user_id").alias("index")).distinct()
        meta = self._meta()
        if meta is not None:
            names = names.join(meta.select("index"), "index", "left_anti")
        if not names.isEmpty():
            self._describe(names, SCHEMA_VERSION, self.location().rsplit("/", 1)[1])

    def _describe(self, names: DataFrame, version: int, location: str) -> None:
        columns = {"version": F.lit(version), "algorithm": F.lit(self.algorithm), "dimension": F.lit(self.dimension), "location": F.lit(location), "created_at": F.current_timestamp()}
        names.withColumns(columns).coalesce(1).write.mode("append").parquet(f"{self.path}/_meta_schema")

    def described(self) -> DataFrame | None:
        meta = self._meta()
        return None if meta is None else latest(meta, ["index"], "created_at")

    def location(self) -> str:
        """Where the log is: the newest row of the store itself says so, no index's description does."""
        meta = self._meta()
        row = None if meta is None else meta.filter("index = '*'").orderBy(F.desc("created_at")).select("location").first()
        return f"{self.path}/{row[0] if row else 'log'}"

    def upsert(self, chunks: DataFrame, version: int | None = None) -> int:
        """chunks (user_id, file_id, file_name, chunk_id, chunk_index, content, vector) replace their files' chunks; the version written."""
        v = time.time_ns() if version is None else version
        rows = chunks.withColumns({"version": F.lit(v).cast("long"), "deleted": F.lit(False), "user_id": F.col("user_id").cast("long")})
        location = self.location()
        rows.select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.mode("append").partitionBy("user_id").parquet(location)
        self.terms.write(self.spark.read.schema(COLUMNS).parquet(location).filter((F.col("version") == v) & ~F.col("deleted")), location)
        return v

    def log(self) -> DataFrame:
        found = self._table(self.location(), COLUMNS)
        return self.spark.createDataFrame([], COLUMNS) if found is None else found

    def read(self, user_id: int | None = None) -> DataFrame:
        log = self.log() if user_id is None else self.log().filter(F.col("user_id") == user_id)
        return latest(log, ["user_id", "file_id"]).filter(~F.col("deleted")).drop("version", "deleted").dropDuplicates(["user_id", "chunk_id"])

    def delete(self, user_id: int, file_id: str) -> int:
        """The number of chunks that went; a tombstone is appended."""
        n = self.read(user_id).filter(F.col("file_id") == file_id).count()
        if n:
            row = self.spark.createDataFrame([(file_id, user_id)], "file_id string, user_id long").withColumns({"version": F.lit(time.time_ns()), "deleted": F.lit(True)})
            row.write.mode("append").partitionBy("user_id").parquet(self.location())
        return n

    def compact(self) -> None:
        """The live rows as a new log; readers turn to it when it is whole."""
        name = f"log_{time.time_ns()}"
        rows = latest(self.log(), ["user_id", "file_id"]).filter(~F.col("deleted")).dropDuplicates(["user_id", "chunk_id"])
        rows.select(*[c.split()[0] for c in COLUMNS.split(", ")]).write.partitionBy("user_id").parquet(f"{self.path}/{name}")
        self.terms.write(self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{name}"), f"{self.path}/{name}")
        self._describe(self.spark.createDataFrame([("*",)], "index string"), SCHEMA_VERSION, name)


def needs_migration(version: Column, algorithm: Column, dimension: Column, to_version: int, to_algorithm: str, to_dimension: int) -> Column:
    """Whether an index differs from the wanted one; one without a description (null version) does not."""
    dims = (dimension > 0) & F.lit(to_dimension > 0) & (dimension != to_dimension)
    return F.when(version.isNull(), F.lit(False)).otherwise((version != to_version) | (algorithm != to_algorithm) | dims)


def rewritten_key(key: Column, old: str, new: str) -> Column:
    """key under the new prefix."""
    return F.when(key.startswith(old), F.concat(F.lit(new), F.substring(key, F.lit(len(old) + 1), F.length(key)))).otherwise(key)


def migrate(store: ParquetChunkStore, algorithm: str, dimension: int, version: int = SCHEMA_VERSION) -> int:
    """Describes every index that differs anew and compacts the store for them; how many there were.  Names with _v are left alone."""
    meta = store.described()
    if meta is None:
        return 0
    old = meta.filter(~F.contains("index", F.lit("_v")) & (F.col("index") != "*")).filter(needs_migration(F.col("version"), F.col("algorithm"), F.col("dimension"), version, algorithm, dimension))
    n = old.count()
    if n:
        store.algorithm, store.dimension = algorithm, dimension
        store.compact()
        store._describe(old.select("index"), version, store.location().rsplit("/", 1)[1])
    return n


__all__ = ["ChunkStore", "ParquetChunkStore", "delete_files", "index_name", "latest", "migrate", "needs_migration", "rewritten_key", "upsert"]
