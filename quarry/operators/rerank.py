"""Reranking: by score, or by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import RerankConfig
from quarry.errors import RERANK_FAILED, require

# How many documents a model takes at once.
MODEL_LIMITS = {"qwen3-rerank": 500, "qwen3-vl-rerank": 100, "gte-rerank-v2": 30_000}
DEFAULT_LIMIT = 500


def by_score(rows: DataFrame, top_n: int = 0, score: str = "relevance_score", key: str = "chunk_id") -> DataFrame:
    """rows by falling score, the first top_n (0: all)."""
    out = rows.orderBy(F.desc(score), key)
    return out.limit(top_n) if top_n > 0 else out


def top_n(asked: int, config: RerankConfig, n_docs: int) -> int:
    n = asked if asked > 0 else config.top_n if config.top_n > 0 else 5
    return min(n, n_docs)


def recall_k(config: RerankConfig, top_k: int) -> int:
    """How many rows to fetch before reranking."""
    if not config.enabled:
        return top_k
    return max(top_k, config.recall_k if config.recall_k > 0 else 4 * top_k)


def limit(model: str) -> int:
    """How many documents a model takes at once; its name counts in any case."""
    return MODEL_LIMITS.get(model.lower(), DEFAULT_LIMIT)


def check_limit(model: str, n: int) -> None:
    require(n <= limit(model), RERANK_FAILED, f"{model} takes at most {limit(model)} documents, got {n}")


def apply_scores(rows: DataFrame, scores: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """rows (position from 0) with the scores (position, score) a model gave; positions out of range are left out."""
    return rows.join(scores.withColumnRenamed("score", "_s"), "position").withColumn("relevance_score", F.col("_s")).drop("_s").orderBy(F.desc("relevance_score"), key).limit(n)


class Reranker:
    """score(query, texts) -> scores; without one, or if it fails, rows keep their order by score."""

    def __init__(self, config: RerankConfig | None = None, score: Callable[[str, list[str]], list[float]] | None = None):
        self.config, self.score = config or RerankConfig(), score

    def rerank(self, query: str, rows: DataFrame, asked: int = 0) -> DataFrame:
        if not self.config.enabled or self.score is None:
            return by_score(rows, asked)
        few = rows.orderBy(F.desc("relevance_score"), "chunk_id").limit(limit(self.config.model)).collect()  # bounded by the model
        try:
            scores = self.score(query, [r["content"] for r in few])
        except Exception:
            return by_score(rows, asked)
        n = top_n(asked, self.config, len(few))
        spark = rows.sparkSession
        table = spark.createDataFrame([(r["chunk_id"], float(s)) for r, s in zip(few, scores)], "chunk_id string, _s double")
        return rows.join(F.broadcast(table), "chunk_id").withColumn("relevance_score", F.col("_s")).drop("_s").orderBy(F.desc("relevance_score"), "chunk_id").limit(n)
