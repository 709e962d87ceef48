"""Recurrences on streams: typed state per key, rows taken in event-time order, late rows dropped by watermark.

The steps are those of ``operators.recurrences``, so a stream gives what a batch over the same rows gives, in whatever
order and micro-batches they arrive, as long as no row comes later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampType

from loomery.operators.recurrences import Recurrence, _plain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """States with several variables need the RocksDB store; set it where the session holds Spark's own default."""
    if spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then takes them in order of time and tie."""

    def __init__(self, recurrence: Recurrence, waiting: StructType, inputs: list[str], names: list[str], drop_repeats: bool):
        self.recurrence, self.schema, self.inputs, self.names, self.drop_repeats = recurrence, waiting, inputs, names, drop_repeats
        self.kept = waiting.fieldNames()
        self.arrays = [isinstance(f.dataType, ArrayType) for f in waiting.fields]
        self.array_state = [isinstance(f.dataType, ArrayType) for f in StructType.fromDDL(recurrence.state).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.recurrence.state)
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", "at bigint, tie bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            fresh = list(zip(*(_plain(part[c]) for c in self.kept)))
            if fresh:
                self.waiting.appendList([tuple(r) for r in fresh])
        yield self._ripe(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._ripe(key, timerValues)

    def close(self) -> None:
        pass

    def _ripe(self, key: tuple, timers) -> pd.DataFrame:
        now = timers.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((r for r in held if r[0] <= now), key=lambda r: r[:2])
        rest = [r for r in held if r[0] > now]
        if self.drop_repeats:  # rows are told apart by time and tie: those taken before, and repeated ones, go
            seen = tuple(self.last.get()) if self.last.exists() else None
            ripe = [r for i, r in enumerate(ripe) if (not i or r[:2] != ripe[i - 1][:2]) and (seen is None or r[:2] > seen)]
        if ripe:
            self.last.update(ripe[-1][:2])
            state = tuple(list(x) if a else x for x, a in zip(self.state.get(), self.array_state)) if self.state.exists() else self.recurrence.start()
            at = {c: i for i, c in enumerate(self.kept)}
            state, made = self.recurrence.step(state, [tuple(list(r[at[c]]) if self.arrays[at[c]] and r[at[c]] is not None else r[at[c]] for c in self.inputs) for r in ripe])
            self.state.update(state)
        else:
            made = []
        if len(rest) < len(held):
            self.waiting.put(rest) if rest else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        rows = [(*key, r[0], r[1], *m) for r, m in zip(ripe, made)]
        return pd.DataFrame(rows, columns=self.names)


def scan_stream(stream: DataFrame, keys: list[str], ts: str, tie: str | Column, inputs: list[str], recurrence: Recurrence, late: str = "1 hour", drop_repeats: bool = True) -> DataFrame:
    """The recurrence's results for each row: ``keys``, ``ts``, ``tie``, then its columns. Output mode append.

    ``tie`` (a whole number) orders rows of one time. A row is taken when the watermark, ``late`` behind the latest
    time seen, has passed it; rows that come later than that are dropped. With ``drop_repeats`` rows that repeat time
    and tie of a key count once, so a source that delivers rows twice changes nothing.
    """
    if not isinstance(stream.schema[ts].dataType, TimestampType):
        raise TypeError(f"{ts} must be a timestamp with a zone")
    needs_rocksdb(stream.sparkSession)
    tie_column = F.col(tie) if isinstance(tie, str) else tie
    kept = stream.withWatermark(ts, late).select(*keys, ts, F.unix_micros(ts).alias("at"), tie_column.cast("bigint").alias("tie"), *inputs)
    waiting = StructType([StructField("at", kept.schema["at"].dataType), StructField("tie", kept.schema["tie"].dataType), *[kept.schema[c] for c in inputs]])
    out = StructType([*[kept.schema[k] for k in keys], waiting["at"], waiting["tie"], *StructType.fromDDL(recurrence.out).fields])
    made = kept.groupBy(*keys).transformWithStateInPandas(_InOrder(recurrence, waiting, inputs, out.fieldNames(), drop_repeats), out, "append", "EventTime")
    return made.select(*keys, F.timestamp_micros("at").alias(ts), "tie", *StructType.fromDDL(recurrence.out).fieldNames())
