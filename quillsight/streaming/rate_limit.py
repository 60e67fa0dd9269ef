"""Per-client request limits over events: windows open at a client's first request, not at clock times.

A window covers the requests up to `window` after the one that opened it (that moment included); the first request strictly after
it opens the next. The first `limit` requests of a window pass; refused ones aren't counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

DECISIONS = "client string, event_id long, micros long, window_start long, place long, allowed boolean, remaining long"


def _decide(micros: np.ndarray, limit: int, window: int, start: int | None = None, used: int = 0) -> tuple[np.ndarray, np.ndarray, int | None, int]:
    """Window start and place in the window of each of a client's requests in order of time; and the state after them."""
    starts = np.empty(len(micros), dtype=np.int64)
    places = np.empty(len(micros), dtype=np.int64)
    i = 0
    while i < len(micros):
        if start is None or micros[i] > start + window:
            start, used = int(micros[i]), 0
        end = int(np.searchsorted(micros, start + window, side="right"))
        end = max(end, i + 1)
        starts[i:end] = start
        places[i:end] = used + 1 + np.arange(end - i)
        used += end - i
        i = end
    return starts, places, start, used


def _frame(client: str, ids: np.ndarray, micros: np.ndarray, starts: np.ndarray, places: np.ndarray, limit: int) -> pd.DataFrame:
    return pd.DataFrame({"client": client, "event_id": ids, "micros": micros, "window_start": starts, "place": places, "allowed": places <= limit, "remaining": np.maximum(0, limit - places)})


def limit_requests(events: DataFrame, limit: int = 60, window_seconds: float = 60.0) -> DataFrame:
    """Decide every request in a batch. events: client, event_id, ts. Requests at the same time go by event_id.

    A client's requests stream through one task in order of time, a batch at a time (the window chain is inherently
    sequential), so its history is never held whole.
    """
    window = int(window_seconds * 1e6)
    keyed = events.select(F.col("client").cast("string").alias("client"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, start, used = None, None, 0
        for batch in batches:
            cuts = np.flatnonzero(batch["client"].to_numpy()[1:] != batch["client"].to_numpy()[:-1]) + 1
            for part in np.split(np.arange(len(batch)), cuts):
                if not len(part):
                    continue
                rows = batch.iloc[part]
                name = rows["client"].iloc[0]
                if name != client:
                    client, start, used = name, None, 0
                micros = rows["micros"].to_numpy()
                starts, places, start, used = _decide(micros, limit, window, start, used)
                yield _frame(name, rows["event_id"].to_numpy(), micros, starts, places, limit)

    return keyed.repartition("client").sortWithinPartitions("client", "micros", "event_id").mapInPandas(decide, DECISIONS)


STATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("used", T.LongType())])


def limit_requests_stream(events: DataFrame, limit: int = 60, window_seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The same for a stream, with the open window of each client as keyed state.

    A client's state is dropped once the watermark (`late` behind the newest request) has passed its window, when a next request would open a
    new one anyway. Within a micro-batch requests are put in order of time; one older than its client's window counts in that window.
    """
    window = int(window_seconds * 1e6)
    keyed = events.select(F.col("client").cast("string").alias("client"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    keyed = keyed.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["micros", "event_id"])
        micros = rows["micros"].to_numpy()
        starts, places, start, used = _decide(micros, limit, window, start, used)
        state.update((start, used))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (start + window) // 1000 + 1))
        yield _frame(key[0], rows["event_id"].to_numpy(), micros, starts, places, limit)

    return keyed.groupBy("client").applyInPandasWithState(decide, DECISIONS, STATE, "append", "EventTimeTimeout")
