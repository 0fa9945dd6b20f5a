"""The inverted index of a store's log: which terms every chunk holds, written beside the log when files are.

`<log>_terms` has a row a chunk and term, sorted by user and term, so a search reads the row groups of its terms;
`<log>_files` has a row a file version and is written after its terms.  A live file without such a row (an older store, a
writer that was lost) is counted from its contents, so results don't depend on the index being whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import keywords
from quarry.operators import search

TERMS = "file_id string, version long, chunk_id string, n int, term string, tf int, user_id long"
FILES = "file_id string, version long, chunks long, terms long, user_id long"


class TermIndex:
    def __init__(self, store):
        self.store = store

    def write(self, rows: DataFrame, location: str) -> None:
        """Adds rows (user_id, file_id, version, chunk_id, content) of the log there."""
        own = ["user_id", "file_id", "version"]
        chunks = rows.select(*own, "chunk_id", "content").dropDuplicates(["user_id", "chunk_id", "version"])
        counted = chunks.withColumn("_t", keywords(F.coalesce("content", F.lit("")))).withColumn("n", F.size("_t"))
        terms = counted.select(*own, "chunk_id", "n", F.explode("_t").alias("term")).groupBy(*own, "chunk_id", "n", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        order = ["user_id", "term", "chunk_id"]  # the last one parts a frequent term
        terms.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("user_id").parquet(f"{location}_terms")
        files = counted.groupBy(*own).agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("terms"))
        files.write.mode("append").partitionBy("user_id").parquet(f"{location}_files")

    def _read(self, part: str, schema: str, user_id: int) -> DataFrame:
        found = self.store._table(f"{self.store.location()}_{part}", schema)
        return (self.store.spark.createDataFrame([], schema) if found is None else found).filter(F.col("user_id") == user_id)

    def search(self, user_id: int, query: str, k: int, where: Column | None = None, match_all: bool = True) -> DataFrame:
        """(chunk_id, score) as `search.bm25` gives them for the user's live chunks; `where` is on file_id."""
        key, terms = ["file_id", "version"], search.query_terms(query)
        log = self.store.log().filter(F.col("user_id") == user_id)
        if not terms:
            return log.limit(0).select("chunk_id", F.lit(0.0).alias("score"))
        live = log.groupBy("file_id").agg(F.max("version").alias("version"), F.max_by("deleted", "version").alias("_gone")).filter(~F.col("_gone")).drop("_gone")
        live = live if where is None else live.filter(where)
        files = self._read("files", FILES, user_id).groupBy(*key).agg(F.max("chunks").alias("_docs"), F.max("terms").alias("_sum")).join(live, key, "left_semi")
        held = self._read("terms", TERMS, user_id).filter(F.col("term").isin(terms)).join(files, key, "left_semi")
        freq = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i, t in enumerate(terms)]
        counted = held.groupBy("chunk_id").agg(F.max("n").alias("_n"), *freq)
        sizes = files.select("_docs", "_sum")
        loose = live.join(files.select(*key), key, "left_anti")
        if not loose.isEmpty():
            rest = search.term_counts(log.join(loose, key, "left_semi").dropDuplicates(["chunk_id"]), terms).select(*counted.columns)
            counted = counted.unionByName(rest)
            sizes = sizes.union(rest.agg(F.count(F.lit(1)), F.sum("_n")))
        totals = sizes.agg(F.sum("_docs").alias("_docs"), (F.sum("_sum") / F.sum("_docs")).alias("_mean"))
        totals = totals.crossJoin(F.broadcast(counted.agg(*search.document_counts(len(terms)))))  # one row each
        return search.best(counted, totals, len(terms), k, match_all=match_all)
