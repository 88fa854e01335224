"""Request streams: hourly counters with a watermark, and a fixed-window rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bucketscope.operators.metrics import counters

LIMITED = "user_id long, requests long, allowed long, rejected long"


def hourly_stream(log: DataFrame, late: str = "168 hours") -> DataFrame:
    """Hourly counters by bucket; requests later than the watermark are dropped."""
    rows = log.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", late)
    return rows.groupBy(F.window("occurred_at", "1 hour"), "bucket").agg(*counters()).withColumn("hour_utc", F.col("window.start")).drop("window")


def _walk(times: list[float], start: float | None, count: int, limit: int, window: float) -> tuple[float | None, int, int]:
    """Start of the window and its count after the requests, and how many were allowed. A window begins with the first request after the last one's end."""
    allowed = 0
    for t in times:
        if start is None or t >= start + window:
            start, count = t, 0
        if count < limit:
            count += 1
            allowed += 1
    return start, count, allowed


def limited(log: DataFrame, limit: int, window_s: float) -> DataFrame:
    """user_id, requests, allowed, rejected: each user's requests in order, streamed through a sorted partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, total, ok, out = None, (None, 0), 0, 0, []
        for f in frames:
            for u, t in zip(f["user_id"], f["t"], strict=True):
                if u != user:
                    if total:
                        out.append((user, total, ok, total - ok))
                    user, state, total, ok = u, (None, 0), 0, 0
                start, count, a = _walk([t], *state, limit, window_s)
                state, total, ok = (start, count), total + 1, ok + a
        if total:
            out.append((user, total, ok, total - ok))
        yield pd.DataFrame(out, columns=["user_id", "requests", "allowed", "rejected"])

    rows = log.select("user_id", F.expr("unix_micros(cast(occurred_at as timestamp)) / 1e6").alias("t"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "t").mapInPandas(run, LIMITED)


def limited_stream(log: DataFrame, limit: int, window_s: float) -> DataFrame:
    """The same on a stream, with a state of window start and count; a state idle for a day goes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        times = sorted(t for f in frames for t in f["t"])
        start, count, ok = _walk(times, start, count, limit, window_s)
        state.update((start, count))
        state.setTimeoutDuration(24 * 3600 * 1000)
        yield pd.DataFrame([(key[0], len(times), ok, len(times) - ok)], columns=["user_id", "requests", "allowed", "rejected"])

    rows = log.select("user_id", F.expr("unix_micros(cast(occurred_at as timestamp)) / 1e6").alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(step, LIMITED, "start double, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)
