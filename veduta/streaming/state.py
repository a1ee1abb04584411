"""Streaming forms: suppression with time-to-live state, and progressive NDJSON output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def suppressed(stream: DataFrame, key: str, ttl: int, idle_ms: int | None = None) -> DataFrame:
    """Rows of (key long, at long, event_id long) with ``fetched``, as the batch fold gives; the state is one number per key.

    Rows of a micro-batch are taken in time order within a key; rows that arrive in a later batch than their time are judged then. With ``idle_ms``, well above
    ``ttl``, the state of a key without rows for that much processing time goes; such a stream runs on, so it suits no trigger that ends by itself.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -(1 << 62)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at in rows["at"]:
            out.append(at >= until)
            until = at + ttl if at >= until else until
        state.update((int(until),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "fetched": out})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} long, event_id long, fetched boolean", "until long", "append", timeout
    )


def written(batch: DataFrame, batch_id: int, path: str, others: Sequence[str] = ()) -> None:
    """One micro-batch as JSON lines below ``path``, in a folder of its own: a replay writes the same folder again. Then the same rows for each other log."""
    batch = batch.persist()
    try:
        for to in (path, *others):
            batch.write.mode("overwrite").json(f"{to}/batch={batch_id}")
    finally:
        batch.unpersist()


def ndjson(stream: DataFrame, path: str, checkpoint: str, others: Sequence[str] = ()):
    """Each micro-batch written once as JSON lines: results first, then the logs that must follow them."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, n: written(batch, n, path, others)
    ).start()
