"""Provider scheduling over call logs: statistics, breaker, and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(calls: DataFrame, provider: str = "provider", ok: str = "ok", latency: str = "latency", open_providers: DataFrame | None = None) -> DataFrame:
    """One row for each provider of a call log: counts, success rate, latency over successes, status.

    Status: unhealthy with an open breaker, healthy from 95 % success on, else degraded.
    """
    n, good = F.count(F.lit(1)), F.count_if(F.col(ok))
    out = calls.groupBy(F.col(provider).alias("provider")).agg(
        n.alias("total_requests"),
        good.alias("success_requests"),
        (n - good).alias("failed_requests"),
        (good * 100.0 / n).alias("success_rate"),
        F.coalesce(F.try_divide(F.sum(latency), good), F.lit(0.0)).alias("avg_latency"),
    )
    if open_providers is None:
        out = out.withColumn("circuit_state", F.lit("closed"))
    else:
        flagged = open_providers.select("provider", F.lit("open").alias("circuit_state")).distinct()
        out = out.join(flagged, "provider", "left").fillna({"circuit_state": "closed"})
    status = F.when(F.col("circuit_state") == "open", "unhealthy").when(F.col("success_rate") >= 95, "healthy").otherwise("degraded")
    return out.withColumn("status", status)


def failure_runs(calls: DataFrame, provider: str = "provider", ok: str = "ok", order: str = "seq") -> DataFrame:
    """calls with `fails`, the failures in a row up to each call: islands of a running count of successes."""
    w = Window.partitionBy(provider).orderBy(order)
    island = F.sum(F.when(F.col(ok), 1).otherwise(0)).over(w)
    marked = calls.withColumn("_island", island)
    inside = Window.partitionBy(provider, "_island").orderBy(order)
    return marked.withColumn("fails", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(inside)).drop("_island")


def breaker_openings(calls: DataFrame, threshold: int = 5, provider: str = "provider", ok: str = "ok", order: str = "seq") -> DataFrame:
    """The calls at which a provider's failures in a row reach the threshold."""
    return failure_runs(calls, provider, ok, order).filter(F.col("fails") == threshold)


def by_priority(providers: DataFrame) -> DataFrame:
    return providers.orderBy("priority", "name")


def round_robin(requests: DataFrame, n_providers: int, order: str = "request") -> DataFrame:
    """requests with the number of their provider, in turn; `order` is a dense request number from 0."""
    return requests.withColumn("provider_no", (F.col(order) % n_providers).cast("int"))


def weight_ranges(providers: DataFrame, name: str = "name", weight: str = "weight") -> DataFrame:
    """(name, lo, hi): cumulative weights in order of name.  Providers are few."""
    total = F.sum(weight).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    return providers.select(F.col(name).alias("name"), (total - F.col(weight)).alias("lo"), total.alias("hi"))


def weighted_pick(requests: DataFrame, providers: DataFrame, draw: str = "draw") -> DataFrame:
    """requests with the provider in whose range of cumulative weights their draw falls: a range join with the few providers."""
    r = weight_ranges(providers)
    return requests.join(r, (F.col(draw) >= F.col("lo")) & (F.col(draw) < F.col("hi")))


def backoff(attempt: Column, base: float, multiplier: float, cap: float) -> Column:
    """The delay before a retry, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(multiplier), attempt), F.lit(cap))
