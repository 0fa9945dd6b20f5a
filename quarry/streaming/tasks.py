"""Asynchronous indexing: a directory of task messages as a stream, a log of status events, at-least-once with idempotent writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import TaskConfig
from quarry.sources.shared import shared_path

MESSAGE = "task_id string, user_id long, file_id string, file_name string, content string, format string, created_at timestamp"
EVENT = "task_id string, status string, error string, at timestamp"


def current_status(events: DataFrame, task: str = "task_id", order: str = "at", status: str = "status") -> DataFrame:
    """(task, status, updated_at): the newest event of every task."""
    return events.groupBy(task).agg(F.max_by(status, order).alias("status"), F.max(order).alias("updated_at"))


def stale_claims(claims: DataFrame, acks: DataFrame, now: Column, timeout_seconds: int = 300, key: str = "task_id", at: str = "at") -> DataFrame:
    """Claims without an acknowledgement that are older than the timeout."""
    return claims.join(acks.select(key).distinct(), key, "left_anti").filter(F.col(at) < now - F.make_dt_interval(secs=F.lit(timeout_seconds)))


def unexpired(rows: DataFrame, now: Column, ttl_seconds: int = 24 * 3600, at: str = "updated_at") -> DataFrame:
    return rows.filter(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


class TaskQueue:
    def __init__(self, spark: SparkSession, path: str, config: TaskConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or TaskConfig()

    def _event(self, task_id: str, status: str, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(task_id, status, error, datetime.now(timezone.utc))], EVENT)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def submit(self, user_id: int, file_id: str, content: str, file_name: str = "", format: str = "") -> str:
        """The id of a pending task; the status is written before the message."""
        task_id = uuid.uuid4().hex
        self._event(task_id, "pending")
        try:
            row = (task_id, user_id, file_id, file_name or file_id, content, format, datetime.now(timezone.utc))
            self.spark.createDataFrame([row], MESSAGE).coalesce(1).write.mode("append").parquet(f"{self.path}/messages")
        except Exception as e:
            self._event(task_id, "failed", str(e)[:500])
            raise
        return task_id

    def status(self, task_id: str):
        """The task's row (task_id, status, updated_at), or None if there is no such task or its time to live is over."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/events")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        events = self.spark.read.schema(EVENT).parquet(f"{self.path}/events").filter(F.col("task_id") == task_id)
        return unexpired(current_status(events), F.current_timestamp(), self.config.task_ttl_seconds).first()

    def run(self, index: Callable[[DataFrame], None], checkpoint: str | None = None):
        """Indexes all waiting messages; the query.  A batch whose indexing fails is tried message by message, and failures are acknowledged."""

        def batch(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            mark = lambda r, s, e=None: r.select("task_id", F.lit(s).alias("status"), F.lit(e).cast("string").alias("error"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/events")
            mark(rows, "processing")
            try:
                index(rows)
                mark(rows, "completed")
            except Exception:
                for task in [r[0] for r in rows.select("task_id").collect()]:  # one micro-batch's ids
                    one = rows.filter(F.col("task_id") == task)
                    try:
                        index(one)
                        mark(one, "completed")
                    except Exception as e:
                        mark(one, "failed", str(e)[:500])
            rows.unpersist()

        stream = self.spark.readStream.schema(MESSAGE).parquet(f"{self.path}/messages")
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return query


BREAKER_OUT = "provider string, seq long, ok boolean, admitted boolean, state string"
BREAKER_STATE = "state string, fails int, failed_at double, trials int"


def breaker_stream(calls: DataFrame, threshold: int = 5, timeout: float = 60.0, trials: int = 3) -> DataFrame:
    """A stream of calls (provider, seq, at: seconds, ok) through one breaker for each provider, as (provider, seq, ok, admitted, state after)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, fails, failed_at, used = state.get if state.exists else ("closed", 0, 0.0, 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if now == "open" and r.at - failed_at > timeout:
                now, used = "half_open", 0
            elif now == "half_open":
                used += 1
            admitted = now == "closed" or (now == "half_open" and used <= trials)
            if admitted and r.ok:
                now, fails = "closed", 0
            elif admitted:
                fails, failed_at = fails + 1, float(r.at)
                if now == "half_open" or fails >= threshold:
                    now = "open"
            out.append((key[0], r.seq, r.ok, admitted, now))
        state.update((now, int(fails), float(failed_at), int(used)))
        yield pd.DataFrame(out, columns=["provider", "seq", "ok", "admitted", "state"])

    return calls.groupBy("provider").applyInPandasWithState(step, BREAKER_OUT, BREAKER_STATE, "append", "NoTimeout")


def written(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that waits now, as a Parquet table in the shared folder: executors write it, the driver holds no row."""
    path = shared_path(stream.sparkSession, "stream")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
