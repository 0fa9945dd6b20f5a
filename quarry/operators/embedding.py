"""Embedding: a registry of embedders, dedup by content hash, and the cache as joins."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import ManagerConfig, ProviderConfig
from quarry.errors import CIRCUIT_OPEN, CONFIG_INVALID, EMBEDDING_FAILED, NO_PROVIDERS, EngineError, require
from quarry.functions.text import content_hash
from quarry.functions.vectors import hashed_embedding

#: type -> factory(ProviderConfig) -> function from a list of texts to a list of vectors
_factories: dict[str, Callable] = {}


def register(kind: str, factory: Callable) -> None:
    _factories[kind] = factory


def registered() -> list[str]:
    return sorted(_factories)


def _local(config: ProviderConfig) -> Callable:
    """Each text's hashed bag of words: the Python twin of hashed_embedding."""
    import hashlib
    import re

    word = re.compile(r"[一-鿿]|[^\W_一-鿿]+")

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * config.dimension
            for w in word.findall((t or "").lower()):
                h = int(hashlib.md5(w.encode()).hexdigest()[:7], 16)
                v[h % config.dimension] += 1.0 if h // config.dimension % 2 == 0 else -1.0
            out.append(v)
        return out

    return embed


register("local", _local)


def providers(configs: list[ProviderConfig]) -> list[tuple[ProviderConfig, Callable]]:
    """The valid and enabled providers; an error if there is none."""
    found = [(c, _factories[c.type](c)) for c in configs if c.enabled and c.name and c.type in _factories]
    require(bool(found), NO_PROVIDERS, "no provider could be created")
    return found


def backoff_seconds(attempt: int, config: ManagerConfig | None = None, jitter: float = 0.0) -> float:
    """min(base * multiplier ** attempt, cap), and up to a quarter more by jitter in [0, 1)."""
    c = config or ManagerConfig()
    delay = min(c.retry_delay * c.retry_multiplier**attempt, c.retry_max_delay)
    return delay * (1 + jitter / 4)


class Breaker:
    """closed -> open after `threshold` failures in a row; half-open after the timeout, for a few calls; success closes."""

    def __init__(self, config: ManagerConfig, clock: Callable[[], float] = time.monotonic):
        self.config, self.clock = config, clock
        self.state, self.fails, self.failed_at, self.trials = "closed", 0, 0.0, 0

    def usable(self) -> bool:
        """Whether a call could be admitted now; asking uses no trial."""
        return self.state == "closed" or (self.state == "open" and self.clock() - self.failed_at > self.config.circuit_timeout) or (self.state == "half_open" and self.trials < self.config.circuit_half_open_max)

    def admits(self) -> bool:
        if self.state == "open" and self.clock() - self.failed_at > self.config.circuit_timeout:
            self.state, self.trials = "half_open", 0
            return True
        if self.state == "half_open":
            self.trials += 1
            return self.trials <= self.config.circuit_half_open_max
        return self.state == "closed"

    def record(self, ok: bool) -> None:
        if ok:
            self.state, self.fails = "closed", 0
            return
        self.fails += 1
        self.failed_at = self.clock()
        if self.state == "half_open" or self.fails >= self.config.circuit_threshold:
            self.state = "open"


class Manager:
    """Calls providers by strategy (priority, round_robin, random, weighted), with retries and breakers; counts its calls."""

    def __init__(self, configs: list[ProviderConfig], config: ManagerConfig | None = None, clock=time.monotonic, sleep=time.sleep, seed: int = 0):
        self.config = config or ManagerConfig()
        require(self.config.strategy in ("priority", "round_robin", "random", "weighted"), CONFIG_INVALID, "unknown strategy")
        self.all = sorted(providers(configs), key=lambda p: p[0].priority)
        self.breakers = {c.name: Breaker(self.config, clock) for c, _ in self.all}
        self.calls: list[tuple[str, bool, float]] = []
        self.turn, self.random, self.clock, self.sleep = 0, random.Random(seed), clock, sleep

    def pick(self, attempt: int) -> tuple[ProviderConfig, Callable]:
        strategy, n = self.config.strategy, len(self.all)
        usable = [p for p in self.all if self.breakers[p[0].name].usable()] or self.all
        if strategy == "round_robin":
            self.turn += 1
            return self.all[(self.turn - 1) % n]
        if strategy == "random":
            return self.random.choice(self.all)
        if strategy == "weighted":
            return self.random.choices(usable, weights=[max(c.weight, 0) or 1 for c, _ in usable])[0]
        return self.all[attempt % n]

    def embed(self, texts: list[str]) -> list[list[float]]:
        last: Exception | None = None
        for attempt in range(self.config.max_retries + 1):
            config, call = self.pick(attempt)
            breaker = self.breakers[config.name]
            if not breaker.admits():
                last = last or EngineError(CIRCUIT_OPEN, config.name)
                continue
            began = self.clock()
            try:
                out = call(texts)
                require(len(out) == len(texts), EMBEDDING_FAILED, "as many vectors as texts are expected")
            except Exception as e:  # any failure of a provider counts
                last = e
                breaker.record(False)
                self.calls.append((config.name, False, self.clock() - began))
                if attempt < self.config.max_retries:
                    self.sleep(backoff_seconds(attempt, self.config, self.random.random()))
                continue
            breaker.record(True)
            self.calls.append((config.name, True, self.clock() - began))
            return out
        raise EngineError(EMBEDDING_FAILED, "all attempts failed", last)


def embedder(configs: list[ProviderConfig] | None = None, manager: ManagerConfig | None = None, batch: int = 10) -> Callable[[Column | str], Column]:
    """A column function text -> vector.  All run in Arrow batches, the built-in local provider as one Pandas UDF over its keywords."""
    configs = configs or [ProviderConfig(name="local")]
    enabled = [c for c in configs if c.enabled]
    if len(enabled) == 1 and enabled[0].type == "local":
        return lambda c: hashed_embedding(c, enabled[0].dimension)
    factories = dict(_factories)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _factories.update(factories)
        m = Manager(configs, manager)  # one for each task
        for texts in parts:
            out: list = []
            for i in range(0, len(texts), batch):
                out.extend(m.embed(texts.iloc[i : i + batch].tolist()))
            yield pd.Series(out)

    return lambda c: run(F.col(c) if isinstance(c, str) else c)


def split_by_cache(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, misses) of texts against a cache (hash, vector)."""
    keyed = texts.withColumn("hash", content_hash(text))
    return keyed.join(cache.select("hash", "vector"), "hash"), keyed.join(cache, "hash", "left_anti")


def embed_cached(texts: DataFrame, cache: DataFrame, embed: Callable[[Column | str], Column], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with hash, vector and cached; the new cache rows): every distinct missing text is embedded once."""
    keyed = texts.withColumn("hash", content_hash(text))
    known = cache.select("hash", "vector", F.lit(True).alias("cached"))
    missing = keyed.join(known, "hash", "left_anti").groupBy("hash").agg(F.min(text).alias("_t"))
    fresh = missing.select("hash", embed("_t").alias("vector"), F.lit(False).alias("cached"))
    return keyed.join(known.unionByName(fresh), "hash"), fresh.drop("cached")


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """cache with rows (hash, vector): a hash has its newest vector."""
    both = cache.select("hash", "vector", F.lit(0).alias("v")).union(rows.select("hash", "vector", F.lit(1).alias("v")))
    return both.groupBy("hash").agg(F.max_by("vector", "v").alias("vector"))


def kept_entries(entries: DataFrame, capacity: int, now: Column) -> DataFrame:
    """The `capacity` most recently used entries (hash, last_access, expires_at) that haven't expired."""
    return entries.filter(F.col("expires_at") > now).orderBy(F.desc("last_access"), "hash").limit(capacity)


def cache_stats(lookups: DataFrame, hit: str = "hit") -> DataFrame:
    """hits, misses and hit_rate (per cent) of a log of lookups."""
    hits, n = F.count_if(F.col(hit)), F.count(F.lit(1))
    return lookups.agg(hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.try_divide(hits * 100.0, n), F.lit(0.0)).alias("hit_rate"))


def batches(rows: DataFrame, order: str, size: int = 10, partition: str | None = None) -> DataFrame:
    """rows with the number of their batch of `size`, in order, within each value of `partition`."""
    w = Window.partitionBy(partition).orderBy(order) if partition else Window.orderBy(order)
    return rows.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
