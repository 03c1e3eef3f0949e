"""First-wins de-duplication in event time, with state.

For each key the row with the earliest event time (then the smallest tie) is
the first; all later ones are duplicates. A stream brings rows out of order, so
a key's earliest row so far is kept in state until the watermark has passed it
and only then put out. Rows that come behind the watermark can no longer be
put in order: they go to the side output as ``late``, whether they would have
been first or not. What is put out is never taken back.

Keys are dealt to a fixed number of buckets, and a bucket's keys are worked on
together: its rows come in one call, its state is read and written once in a
micro-batch, and one timer stands for its next key. So a batch costs a few calls
for each bucket, not for each key. The state holds one row for each key that
waits and a mark for each key that is done. With ``forget_after`` a mark is
cleared when the watermark has passed the first row by that time; the key may
then begin anew.

Null keys are a key like any other. Rows without an event time cannot be
placed and go to the side output at once. Rows that tie in time and tie value
are told apart by their body. A restart from the checkpoint goes on where the
stream stopped, without a row twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, TimestampType

from lodestar.session import configured

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST, LATE = "first", "late"


#: Buckets of keys; a checkpoint holds for one number of them.
BUCKETS = 1024


class FirstWins(StatefulProcessor):
    """The earliest row of each key of a bucket: waiting until its time has passed, then done."""

    def __init__(self, forget_after_ms: int | None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value of columns: a list state is read and written by rows, which costs a hundred times as much
        self.state = handle.getValueState("firsts", "key array<string>, at array<long>, tie array<long>, body array<string>, done array<boolean>")

    def _held(self) -> dict[str, tuple]:
        state = self.state.get() if self.state.exists() else None
        return {} if state is None else {key: tuple(row) for key, *row in zip(*state)}

    def _due(self, held: dict[str, tuple]) -> int | None:
        """When the bucket's next key is to be put out or forgotten."""
        times = (self._forgotten(at) if done else at // 1000 + 1 for at, _, _, done in held.values())  # a millisecond on: rows of the same one are on time
        return min((t for t in times if t is not None), default=None)

    def _forgotten(self, at: int) -> int | None:
        return None if self.forget_after_ms is None else at // 1000 + 1 + self.forget_after_ms

    def _put(self, held: dict[str, tuple]) -> None:
        self.state.update((list(held), *map(list, zip(*held.values())))) if held else self.state.clear()

    def _rows(self, rows: list[tuple], kind: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "at", "tie", "body"])
        out["kind"] = kind
        return out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held, late, changed = self._held(), [], False
        before = self._due(held)
        for batch in rows:
            for name, at, tie, body in zip(*(batch[c].tolist() for c in ("key", "at", "tie", "body"))):
                if at // 1000 < watermark:
                    late.append((name, at, tie, body))
                    continue
                best = held.get(name)
                if best is None or (not best[3] and (at, tie, body) < best[:3]):
                    held[name], changed = (at, tie, body, False), True
        if changed:
            self._put(held)
            if (due := self._due(held)) != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(due)
        if late:
            yield self._rows(late, LATE)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        first, left = [], {}
        for name, (at, tie, body, done) in self._held().items():
            if not done and at // 1000 < watermark:
                first.append((name, at, tie, body))
                left[name] = (at, tie, None, True)
            elif not done or self.forget_after_ms is None or self._forgotten(at) > watermark:
                left[name] = (at, tie, body, done)
        self._put(left)
        if (due := self._due(left)) is not None:
            self.handle.registerTimer(max(due, watermark + 1))
        if first:
            yield self._rows(first, FIRST)

    def close(self) -> None:
        pass


def _told(name: str, kind: DataType) -> Column:
    """A key's value as text, equal where the values are."""
    c = F.col(name)
    if isinstance(kind, (FloatType, DoubleType)):
        c = c + F.lit(0).cast(kind)  # no negative zero
    return F.hex(c) if isinstance(kind, BinaryType) else F.unix_micros(c).cast("string") if isinstance(kind, TimestampType) else c.cast("string")


def _value(told: Column, kind: DataType) -> Column:
    return F.unhex(told) if isinstance(kind, BinaryType) else F.timestamp_micros(told.cast("long")) if isinstance(kind, TimestampType) else told.cast(kind)


def first_wins(stream: DataFrame, keys: list[str], at: str, tie: Column, delay: str, forget_after_ms: int | None = None) -> DataFrame:
    """``keys``, at (microseconds), tie, body (the row as JSON) and kind (first or late), from a stream of rows with the timestamp ``at``.

    ``tie``: a long that orders rows of one time. Each first row comes once,
    when the watermark (the latest time seen but for ``delay``) has passed it.
    """
    marked, kinds = stream.withWatermark(at, delay), [stream.schema[k].dataType for k in keys]
    # the time is taken over by a column of its own: rows behind the watermark reach the operator, which sorts them out
    time = F.coalesce(F.unix_micros(F.expr(f"`{at}` + INTERVAL 0 SECONDS")), F.lit(-1))
    key = F.to_json(F.array(*[_told(k, kind) for k, kind in zip(keys, kinds)]))
    rows = marked.select(key.alias("key"), time.alias("at"), F.coalesce(tie.cast("long"), F.lit(0)).alias("tie"), F.to_json(F.struct(*stream.columns)).alias("body"))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "*").groupBy("bucket")
    found = dealt.transformWithStateInPandas(FirstWins(forget_after_ms), "key string, at long, tie long, body string, kind string", "append", "EventTime")
    told = F.from_json("key", "array<string>")
    return found.select(*[_value(told[n], kind).alias(k) for n, (k, kind) in enumerate(zip(keys, kinds))], "at", "tie", "body", "kind")


def start(spark: SparkSession, found: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write firsts and late rows to the folders ``kind=first`` and ``kind=late`` of ``out``, each row once."""
    with configured(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):  # a query keeps the settings it began with
        writer = found.writeStream.format("parquet").partitionBy("kind").option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
