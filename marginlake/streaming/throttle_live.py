"""The throttle rule as a stream: keyed state with a timer for each key.

A key's events wait until the watermark has passed them, so that they are taken
in order however they arrive; then they open windows or count in them, as in the
batch audit. A window is reported once the watermark has passed its end. State
holds one open window and the instants within the delay, for each key.
"""

from __future__ import annotations

import datetime as dt
from array import array
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
WINDOWS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("window_start", T.LongType()),
        T.StructField("events", T.LongType()),
        T.StructField("allowed", T.LongType()),
        T.StructField("rejected", T.LongType()),
    ]
)


#: Instants in one element of the state.
CHUNK = 4096
_MICRO = dt.timedelta(microseconds=1)
_ZERO = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _packed(instants: dict[int, int]) -> tuple[bytes]:
    """Instants and their counts as one binary value."""
    return (array("q", [*instants.keys(), *instants.values()]).tobytes(),)


def _unpacked(chunk: tuple[bytes]) -> Iterator[tuple[int, int]]:
    numbers = array("q", bytes(chunk[0]))
    return zip(numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :], strict=True)


class Throttle(StatefulProcessor):
    """One open window and the waiting instants of a key.

    Instants wait in chunks, one for what a batch brings, so that the calls to the state
    store grow with the batches of a key, not with its events.
    """

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "anchor long, events long")
        self.waiting = handle.getListState("waiting", "instants binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came: dict[int, int] = {}
        first = None
        for row in rows:
            t = (row["at"] - _ZERO) // _MICRO
            came[t] = came.get(t, 0) + 1
            first = t if first is None else min(first, t)
            if len(came) == CHUNK:
                self.waiting.appendValue(_packed(came))
                came = {}
        if came:
            self.waiting.appendValue(_packed(came))
        self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # the watermark has passed what lies before
        held: dict[int, int] = {}
        for chunk in self.waiting.get():
            for t, n in _unpacked(chunk):
                held[t] = held.get(t, 0) + n
        due = sorted(t for t in held if t < now)
        window = self.window.get()
        anchor, events = window if window else (None, 0)
        if not due and (anchor is None or anchor + self.span >= now):
            return  # another timer of this watermark has done it all, and set the next one
        for t in due:
            if anchor is None or t > anchor + self.span:
                if anchor is not None:
                    yield self._row(key, anchor, events)
                anchor, events = t, 0
            events += held.pop(t)
        if anchor is not None and anchor + self.span < now:
            yield self._row(key, anchor, events)
            anchor = None
        if anchor is not None:
            self.window.update((anchor, events))
        elif window:
            self.window.clear()
        if due and held:
            left = sorted(held.items())
            self.waiting.put([_packed(dict(left[k : k + CHUNK])) for k in range(0, len(left), CHUNK)])
        elif due:
            self.waiting.clear()
        if held or anchor is not None:
            self._wake(min([*held, *([] if anchor is None else [anchor + self.span])]))

    def _wake(self, t: int) -> None:
        """Call again once the watermark is later than ``t``."""
        self.handle.registerTimer(t // 1000 + 1)

    def _row(self, key: Any, anchor: int, events: int) -> Row:
        allowed = min(events, self.limit)
        return Row(key=key[0], window_start=anchor, events=events, allowed=allowed, rejected=events - allowed)

    def close(self) -> None:
        pass


def audit_stream(events: DataFrame, *, key: str, at: str, limit: int, window: int, delay: str) -> DataFrame:
    """Windows per key, as ``throttle.audit`` has them, as soon as they are over.

    ``delay``: how much later than the newest event an event may come; later ones
    are left out, as are events without a time. Needs a state store that keeps state by columns
    (``spark.sql.streaming.stateStore.providerClass``: RocksDB).
    """
    none = F.col(key).isNull()
    named = events.where(F.col(at).isNotNull()).select(
        F.when(none, "-").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))).alias("key"),
        F.col(at).cast("timestamp").alias("at"),
    )
    found = named.withWatermark("at", delay).groupBy("key").transformWithState(
        statefulProcessor=Throttle(limit, window * MICROS), outputStructType=WINDOWS, outputMode="Append", timeMode="EventTime"
    )
    return found.select(
        F.when(F.col("key") != "-", F.substring("key", 2, 2_000_000_000)).alias("key"),
        F.timestamp_micros("window_start").alias("window_start"),
        "events",
        "allowed",
        "rejected",
    )


def save_windows(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to ``path``; drains what is there and stops."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
