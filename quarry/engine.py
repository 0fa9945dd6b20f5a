"""The engine: search, index, prompt, chunk, parse, delete and status over one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.errors import INVALID_INPUT, TOO_LARGE, EngineError, require
from quarry.functions import text as T
from quarry.operators import chunking, embedding, markdown, pdf, prompt, rerank, search
from quarry.sources.cache import EmbeddingCache
from quarry.sources.shipping import ship
from quarry.sources.store import ParquetChunkStore
from quarry.streaming.tasks import TaskQueue


class Engine:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, scorer=None, pages=None):
        ship(spark)
        self.spark, self.path, self.config = spark, path, config or Config()
        self.store = ParquetChunkStore(spark, f"{path}/chunks", self.config.retriever.index_algorithm, self.config.retriever.dimension)
        self.queue = TaskQueue(spark, f"{path}/tasks", self.config.tasks)
        self.embed = embedding.embedder(self.config.providers, self.config.manager, self.config.retriever.embedding_batch_size)
        self.cache = EmbeddingCache(spark, f"{path}/cache", self.config.cache)
        self.pages = pages  # a PDF reader: bytes -> pages of rows of cells
        self.reranker = rerank.Reranker(self.config.rerank, scorer)

    def parse(self, docs: DataFrame, content: str = "content", format: str | None = None) -> DataFrame:
        """docs with format, title, parsed text, sections and counts; an unknown format counts as text."""
        kind = T.detect_format(content) if not format else F.lit(format if format in ("markdown", "html") else "text")
        d = docs.withColumn("format", kind)
        html, md = F.col("format") == "html", F.col("format") == "markdown"
        body = F.when(html, T.html_text(content)).otherwise(F.col(content))
        return d.withColumns(
            {
                "parsed": body,
                "title": F.when(html, T.html_title(content)).when(md, markdown.title(content)).otherwise(""),
                "sections": F.when(md, markdown.sections(content)),
                "word_count": T.word_count(body),
                "char_count": T.char_count(body),
                "content_length": F.octet_length(body),
            }
        )

    def chunk(self, docs: DataFrame, config=None, text: str = "content", doc_id: str = "file_id") -> DataFrame:
        return chunking.choose(docs, config or self.config.chunking, text, doc_id)

    def chunk_rows(self, docs: DataFrame) -> DataFrame:
        """Index rows, with vectors, of docs (user_id, file_id, file_name, content): equal contents are embedded once, over all calls if the cache is on."""
        keyed = docs.withColumn("_key", F.concat_ws("\x1f", F.col("user_id").cast("string"), "file_id"))
        cut = self.chunk(keyed, doc_id="_key").withColumnRenamed("doc_id", "_key")
        rows = cut.join(keyed.select("_key", "user_id", "file_id", "file_name"), "_key").drop("_key")
        rows = rows.withColumn("chunk_id", chunking.chunk_id("user_id", "file_id", "chunk_index", "content"))
        if self.config.cache.enabled:
            self.cache.fill(rows, self.embed, "content")
            return rows.withColumn("hash", T.content_hash("content")).join(self.cache.read(), "hash")
        empty = self.spark.createDataFrame([], "hash string, vector array<float>")
        return embedding.embed_cached(rows, empty, self.embed, "content")[0]

    def read_content(self, docs: DataFrame, format: str | None = None) -> DataFrame:
        """docs (user_id, file_id, ..., content) with the text of their contents, by `format` or a column of that name; what can't be parsed stays as it is.

        Without a format only PDFs are recognised, and read if the engine has a reader.
        """
        kind = F.lit(format or "") if format or "format" not in docs.columns else F.coalesce(F.lower("format"), F.lit(""))
        out = docs.withColumn("content", F.when(kind == "html", T.html_text("content")).otherwise(F.col("content"))).drop("format")
        if self.pages is None:
            return out
        key = F.concat_ws("\x1f", F.col("user_id").cast("string"), "file_id")
        raw = docs.filter(pdf.is_pdf("content") & kind.isin("", "pdf")).select(key.alias("_key"), pdf.decoded("content").alias("content")).filter("content is not null")
        texts = pdf.page_text(pdf.page_rows(raw, self.pages, "content", "_key")).select(F.col("doc_id").alias("_key"), F.col("content").alias("_text"))
        return out.withColumn("_key", key).join(texts, "_key", "left").withColumn("content", F.coalesce("_text", "content")).drop("_key", "_text")

    def index(self, docs: DataFrame, format: str | None = None) -> DataFrame:
        """Stores docs (user_id, file_id, file_name, content; format if there is one) in place of their files' chunks; a summary by file of what was written."""
        too_large = docs.filter(~T.size_ok("content", self.config.max_content_bytes)).select("file_id").first()
        require(too_large is None, TOO_LARGE, f"{too_large and too_large[0]} is too large")
        bad = docs.filter("user_id is null or user_id <= 0 or coalesce(file_id, '') = '' or coalesce(content, '') = ''").select("file_id").first()
        require(bad is None, INVALID_INPUT, "user_id, file_id and content are required")
        docs = self.read_content(docs, format)
        self.store.ensure_all(docs)
        version = self.store.upsert(self.chunk_rows(docs))
        return self.store.log().filter(F.col("version") == version).groupBy("user_id", "file_id").agg(F.max("file_name").alias("file_name"), F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("vector").isNotNull()).alias("indexed"))

    def index_async(self, user_id: int, file_id: str, content: str, file_name: str = "", format: str = "") -> str:
        self._check(user_id, content, file_id)
        require(len(content.encode()) <= self.config.max_content_bytes, TOO_LARGE, f"{file_id} is too large")
        return self.queue.submit(user_id, file_id, content, file_name, format)

    def run_tasks(self):
        return self.queue.run(lambda rows: self.index(rows.select("user_id", "file_id", "file_name", "content", "format")).count())

    def task_status(self, task_id: str):
        require(bool(task_id), INVALID_INPUT, "task_id is required")
        return self.queue.status(task_id)

    @staticmethod
    def _check(user_id: int, *texts: str) -> None:
        require(user_id > 0, INVALID_INPUT, "user_id must be positive")
        require(all(texts), INVALID_INPUT, "empty argument")

    def _vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(self.embed(F.lit(text)).alias("v")).first()[0])

    def search(self, query: str, user_id: int, top_k: int | None = None, file_ids: list[str] | None = None, min_score: float | None = None, reranked: bool = False) -> DataFrame:
        """Result rows, best first."""
        self._check(user_id, query)
        c = self.config.retriever
        k, least = c.top_k(top_k), c.min_score if min_score is None else min_score
        want = rerank.recall_k(self.config.rerank, k) if reranked else k
        rows, where = self.store.read(user_id), search.in_files(file_ids)
        v = self._vector(query)
        if c.hybrid_search_enabled:
            leg = self.store.terms.search(user_id, query, 9 * want, where)
            hits = search.hybrid(rows, query, v, want, (c.vector_weight, c.keyword_weight), where, min_score=least, text_leg=leg).withColumn("relevance_score", F.col("score"))
        else:
            hits = search.scored(search.knn(rows, v, want, where=where), least, "content")
        hits = self.reranker.rerank(query, hits, k) if reranked else hits.orderBy(F.desc("relevance_score"), "chunk_id")
        return hits.select("chunk_id", "file_id", "file_name", "chunk_index", "content", "relevance_score")

    def build_prompt(self, query: str, user_id: int, top_k: int | None = None, file_ids: list[str] | None = None) -> str:
        hits = search.ranked(self.search(query, user_id, top_k, file_ids), F.desc("relevance_score"), F.col("chunk_id"))
        row = prompt.build(hits, query).first()
        return row[0] if row else query

    def delete(self, file_id: str, user_id: int) -> int:
        self._check(user_id, file_id)
        return self.store.delete(user_id, file_id)

    def status(self) -> DataFrame:
        """Chunks and files by user."""
        return self.store.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_id").alias("files"))

    def decode_pdf(self, docs: DataFrame, pages=pdf.pypdf_pages, content: str = "content", doc_id: str = "file_id") -> DataFrame:
        """(doc_id, content) of base64 PDFs among docs."""
        raw = docs.filter(pdf.is_pdf(content)).select(F.col(doc_id), pdf.decoded(content).alias("content")).filter("content is not null")
        return pdf.page_text(pdf.page_rows(raw, pages, "content", doc_id))


__all__ = ["Engine", "EngineError"]
