"""Streaming micro-batches of requests with bounded admission, and live counters.

A batch of a server closes when it is full or a window after its first request. Requests that find the queue
full are answered at once as overloaded. State is the open batch of each server, so it stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "shard string, request_id long, batch long, status string"
STATE = "batch long, first double, last double, ids array<long>"


def batch_requests(requests: DataFrame, most: int, window_s: float, queue: int | None = None) -> DataFrame:
    """Stream of (shard, request_id, batch, status) from ``requests`` (shard, ts, request_id, with a watermark on ts).

    status is batched or overloaded; a request is overloaded if ``queue`` requests of its shard wait already, in
    the open batch. The open batch is sent once its window lies behind the watermark.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, first, last, ids = state.get if state.exists else (0, 0.0, 0.0, [])
        ids, out = list(ids), []

        def close() -> None:
            nonlocal batch, ids
            out.extend((key[0], i, batch, "batched") for i in ids)
            batch, ids = batch + (1 if ids else 0), []

        if state.hasTimedOut:
            close()
        else:
            rows = pd.concat(list(parts)).sort_values(["us", "request_id"])
            for us, i in zip(rows["us"].tolist(), rows["request_id"].tolist(), strict=True):
                t = us / 1e6
                if ids and (len(ids) == most or t > first + window_s):
                    close()
                if queue is not None and len(ids) >= queue:
                    out.append((key[0], i, -1, "overloaded"))
                    continue
                first = t if not ids else first
                last = t
                ids.append(i)
            if len(ids) == most:
                close()
        state.update((batch, first, last, ids))
        if ids:
            state.setTimeoutTimestamp(max(int((first + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["shard", "request_id", "batch", "status"])

    slim = requests.select("shard", "ts", F.unix_micros("ts").alias("us"), F.col("request_id").cast("long").alias("request_id"))
    return slim.groupBy("shard").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_counters(requests: DataFrame, window: str = "1 day") -> DataFrame:
    """Requests by status and time window, from a watermarked stream (an addition of Spark's own kind)."""
    return requests.groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def tail_log(spark: Any, path: str, schema: str) -> DataFrame:
    """Stream over a folder of append-only JSON logs."""
    return spark.readStream.schema(schema).json(path)


class Service:
    """The life of a streaming query: started once, stopped any number of times, errors passed on."""

    def __init__(self, begin: Callable[[], StreamingQuery]):
        self._begin, self._query = begin, None

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def start(self) -> Service:
        if self.running:
            raise RuntimeError("started already")
        self._query = self._begin()
        return self

    def stop(self) -> None:
        """What was not answered yet stays in the source and is answered after the next start, from the checkpoint."""
        query, self._query = self._query, None
        if query is not None:
            query.stop()

    def failure(self) -> str | None:
        """Why the query ended by itself, if it did."""
        found = self._query.exception() if self._query is not None else None
        return None if found is None else str(found)
