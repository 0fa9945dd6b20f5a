"""The registered stream through breakers, over a table that is one file and one that is a folder."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry.plans import library


def expected(calls, threshold=5, timeout=60.0, trials=3):
    """(seq, admitted, state) by plain code; calls: (provider, seq, at, ok)."""
    out, breakers = set(), {}
    for provider, seq, at, ok in sorted(calls, key=lambda c: c[1]):
        state, fails, failed, used = breakers.get(provider, ("closed", 0, 0.0, 0))
        if state == "open" and at - failed > timeout:
            state, used = "half_open", 0
        elif state == "half_open":
            used += 1
        admitted = state == "closed" or (state == "half_open" and used <= trials)
        if admitted and ok:
            state, fails = "closed", 0
        elif admitted:
            fails, failed = fails + 1, at
            state = "open" if state == "half_open" or fails >= threshold else state
        breakers[provider] = (state, fails, failed, used)
        out.add((seq, admitted, state))
    return out


@pytest.mark.parametrize("folder", [False, True])
def test_breaker_stream_is_written_by_executors(spark, tmp_path, folder):
    start = datetime.datetime(2024, 1, 1)
    calls = [(i % 3, i, 9.0 * i, i % 50 > 30 or i % 7 == 0) for i in range(300)]
    rows = [(i, start + datetime.timedelta(seconds=at), p, "view" if ok else "error") for p, i, at, ok in calls]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    if folder:
        frame.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    else:
        frame.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    got = library.stream_breaker(spark, str(tmp_path))
    assert {(r["seq"], r["admitted"], r["state"]) for r in got.collect()} == expected(calls) and got.count() == 300
    assert got.filter(F.col("state") == "open").count() and got.filter(~F.col("admitted")).count()
    assert got.inputFiles()  # not a table in the driver's memory
