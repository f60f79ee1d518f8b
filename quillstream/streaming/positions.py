"""Saved positions as a stream: change detection and the trailing pause are a file's state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from quillstream.operators.positions import DEBOUNCE_MS


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


STATE = "last int, wait int, since bigint, held array<struct<ts:bigint,page:int>>"
SAVED = "file {kind}, ts_ms bigint, page int"


def saved_positions(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, lateness: str = "10 seconds") -> DataFrame:
    """(file, ts, page): the saves that a stream of events (file, ts, page) leads to, as operators.positions says of a table.

    A page that differs from the one before starts a wait; it is saved when no other change came for
    `debounce_ms`, so a page that stays the same is never saved again. Events are put in order of ts up to `lateness`,
    later ones are left out. A file's state is its last page, the page that waits, and the events that the watermark has not passed.
    """
    kind = events.schema["file"].dataType.simpleString()

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, wait, since, held = state.get if state.exists else (None, None, None, [])
        held = [(h["ts"], h["page"]) if not isinstance(h, tuple) else tuple(h) for h in held or []]
        mark = state.getCurrentWatermarkMs()
        for frame in batches:
            held += [(t, int(p)) for t, p in zip(frame["ts_ms"].tolist(), frame["page"].tolist(), strict=True) if t > mark]
        held.sort()
        saves = []
        passed = [x for x in held if x[0] <= mark]
        for ts, page in passed:
            if page == last:
                continue
            if wait is not None and ts - since > debounce_ms:
                saves.append((since, wait))
            last, wait, since = page, page, ts
        held = held[len(passed) :]
        if wait is not None and mark - since > debounce_ms:  # every event up to the watermark is known
            saves.append((since, wait))
            wait = since = None
        state.update((last, wait, since, held))
        next_time = min([t for t, _ in held[:1]] + ([since + debounce_ms + 1] if wait is not None else []), default=None)
        if next_time is not None:
            state.setTimeoutTimestamp(max(next_time, mark + 1))
        yield pd.DataFrame({"file": [key[0]] * len(saves), "ts_ms": pd.array([t for t, _ in saves], "int64"), "page": pd.array([p for _, p in saves], "int32")})

    marked = events.withWatermark("ts", lateness).select("file", "ts", "page", F.unix_millis("ts").alias("ts_ms"))
    saved = marked.groupBy("file").applyInPandasWithState(step, SAVED.format(kind=kind), STATE, "append", "EventTimeTimeout")
    return saved.select("file", F.timestamp_millis("ts_ms").alias("ts"), "page")


def keep_latest(results: DataFrame) -> DataFrame:
    """Results (token, generation, ...) of which only the newest generation of each token counts."""
    newest = results.groupBy("token").agg(F.max("generation").alias("generation"))
    return results.join(newest, ["token", "generation"])


def write_positions(positions: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append saves to a Parquet table; `once` reads what is there and stops."""
    writer = positions.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
