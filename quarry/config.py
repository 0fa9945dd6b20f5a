"""Settings: dataclasses with defaults, loaded from TOML with ${VAR} expansion, validated."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass

from quarry.errors import CONFIG_INVALID, require


@dataclass
class ChunkingConfig:
    max_chunk_size: int = 1000
    min_chunk_size: int = 100
    overlap_size: int = 200
    structure_aware: bool = True

    def __post_init__(self):
        # zero or less means the default; an overlap of zero can't be asked for
        self.max_chunk_size = self.max_chunk_size if self.max_chunk_size > 0 else 1000
        self.min_chunk_size = self.min_chunk_size if self.min_chunk_size > 0 else 100
        self.overlap_size = self.overlap_size if self.overlap_size > 0 else 200


@dataclass
class RetrieverConfig:
    user_index_name_template: str = "rag_user_%d:idx"
    user_index_prefix_template: str = "rag_user_%d:"
    default_top_k: int = 5
    max_top_k: int = 20
    min_score: float = 0.5
    index_algorithm: str = "FLAT"
    dimension: int = 64
    embedding_batch_size: int = 10
    hybrid_search_enabled: bool = False
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    hnsw_m: int = 16
    hnsw_ef_construction: int = 200

    def __post_init__(self):
        require(1 <= self.default_top_k <= self.max_top_k, CONFIG_INVALID, "default_top_k must lie between 1 and max_top_k")
        require(self.index_algorithm in ("FLAT", "HNSW"), CONFIG_INVALID, f"unknown index algorithm {self.index_algorithm}")
        for w in (self.vector_weight, self.keyword_weight):
            require(0 <= w <= 1, CONFIG_INVALID, "weights lie between 0 and 1")

    def top_k(self, asked: int | None) -> int:
        """The number of rows to return: below 1 the default, and never above the maximum."""
        return min(asked if asked and asked >= 1 else self.default_top_k, self.max_top_k)


@dataclass
class RerankConfig:
    enabled: bool = False
    provider: str = "score"
    model: str = ""
    top_n: int = 5
    recall_k: int = 20
    instruct: str = ""

    def __post_init__(self):
        require(not self.enabled or self.recall_k <= 0 or self.top_n <= self.recall_k, CONFIG_INVALID, "top_n must not exceed recall_k")


@dataclass
class CacheConfig:
    enabled: bool = True
    max_entries: int = 10_000
    ttl_seconds: int = 30 * 60


@dataclass
class ManagerConfig:
    strategy: str = "priority"
    max_retries: int = 3
    retry_delay: float = 0.1
    retry_max_delay: float = 5.0
    retry_multiplier: float = 2.0
    circuit_threshold: int = 5
    circuit_timeout: float = 60.0
    circuit_half_open_max: int = 3


@dataclass
class TaskConfig:
    enabled: bool = False
    claim_timeout_seconds: int = 300
    task_ttl_seconds: int = 24 * 3600


@dataclass
class ProviderConfig:
    name: str = ""
    type: str = "local"
    priority: int = 1
    weight: int = 1
    enabled: bool = True
    dimension: int = 64
    options: dict = field(default_factory=dict)


@dataclass
class Config:
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    retriever: RetrieverConfig = field(default_factory=RetrieverConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    manager: ManagerConfig = field(default_factory=ManagerConfig)
    tasks: TaskConfig = field(default_factory=TaskConfig)
    providers: list[ProviderConfig] = field(default_factory=lambda: [ProviderConfig(name="local")])
    max_content_bytes: int = 10 << 20

    def __post_init__(self):
        require(any(p.enabled for p in self.providers), CONFIG_INVALID, "no provider is enabled")


def expand(text: str, env=None) -> str:
    """${NAME} replaced by the variable's value, '' where it is unset."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), text)


def _build(kind, values: dict):
    own = {f.name: f for f in fields(kind)}
    given = {}
    for name, value in values.items():
        if name not in own:
            continue
        default = own[name].default_factory() if callable(own[name].default_factory) else None
        given[name] = _build(type(default), value) if is_dataclass(default) else [_build(ProviderConfig, v) for v in value] if name == "providers" else value
    return kind(**given)


def load(text: str, env=None) -> Config:
    """Config from TOML text; unknown keys are left out."""
    return _build(Config, tomllib.loads(expand(text, env)))
