"""Lines held back until enough are there or the oldest has waited long enough: state and timers of arbitrary stateful processing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# How many lines make a batch, and how long one waits for it.
LINES, SECONDS = 50, 2.0
FLUSHED = "source string, shard int, flush long, place int, line string, reason string"
#: State with timers needs this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Buffer(StatefulProcessor):
    """One source's (and shard's) waiting lines, always fewer than ``size``, and the number of its next batch.

    The timer is set when a line comes to an empty buffer, so no line waits longer than ``seconds`` and a trigger.
    """

    def __init__(self, size: int, seconds: float):
        self.size, self.millis = size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "line string")
        self.number = handle.getValueState("number", "flush long")

    def _batch(self, key: Any, lines: list[str], reason: str) -> Iterator[Row]:
        flush = self.number.get()[0] if self.number.exists() else 0
        self.number.update((flush + 1,))
        for place, line in enumerate(lines):
            yield Row(source=key[0], shard=key[1], flush=flush, place=place, line=line, reason=reason)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lines = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        had, full = len(lines), False
        for row in rows:
            lines.append(row.line)
            if len(lines) >= self.size:
                yield from self._batch(key, lines, "count")
                lines, full = [], True
        if full:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if lines:
            self.waiting.put([(x,) for x in lines])
            if full or not had:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        elif full:
            self.waiting.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.waiting.exists():
            lines = [r[0] for r in self.waiting.get()]
            self.waiting.clear()
            yield from self._batch(key, lines, "time")


def flushed(lines: DataFrame, size: int = LINES, seconds: float = SECONDS, shards: int = 1) -> DataFrame:
    """A stream of (source, line) as batches of size lines, or fewer once the first has waited for seconds: ``flush`` numbers a source's batches, ``place`` the lines in one.

    A source's lines go through one buffer; with shards, through so many, each
    with its own count, for sources that one task can't follow. A null source is
    one of its own, a null line is left out. The lines wait in a state store and
    survive a lost executor and a restart; the session needs ``PROVIDER``.
    """
    key = F.pmod(F.xxhash64("line"), F.lit(shards)).cast("int").alias("shard")
    keyed = lines.where("line is not null").select("source", key, "line").groupBy("source", "shard")
    return keyed.transformWithState(Buffer(size, seconds), FLUSHED, "append", "processingTime")
