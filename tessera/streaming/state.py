"""Stateful streams: what is known is kept by key in the state store, so no batch reads what was written before.

The state store must be the one on RocksDB (STATE_STORE), which keeps state on local disk and in the checkpoint
and not in memory; query_settings() sets it for a session.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query_settings(spark: SparkSession) -> None:
    """Session settings that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Changed(StatefulProcessor):
    """Lets a row through whose text differs from the last one of its key; the first one of a key does."""

    def __init__(self, text: str | None, order: str | None) -> None:
        self.text, self.order = text, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digest = handle.getValueState("digest", T.StructType([T.StructField("digest", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if self.order:
            batch = batch.sort_values(self.order, kind="stable")
        known = self.digest.get()[0] if self.digest.exists() else None
        keep = []
        for value in batch[self.text] if self.text else [""] * len(batch):
            digest = hashlib.sha256(("" if value is None else str(value)).encode()).hexdigest()
            keep.append(digest != known)
            known = digest
        self.digest.update((known,))
        yield batch[keep]

    def close(self) -> None:
        pass


def _processed(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: T.StructType, times: str = "none") -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=times)


def new_or_changed(rows: DataFrame, keys: Sequence[str], text: str, order: str | None = None) -> DataFrame:
    """Of a stream the rows with a new key, or with another text than the last row of their key had (nulls count as empty).

    Within a batch, rows of a key are taken in the given order. A text that changes back counts as changed.
    State grows with the number of keys, by a digest for each.
    """
    return _processed(rows, keys, _Changed(text, order), rows.schema)


def only_new(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Of a stream the first row of every key, of one batch the first in the given order."""
    return _processed(rows, keys, _Changed(None, order), rows.schema)


class _Flush(StatefulProcessor):
    """Holds the rows of a key and lets them go together once there are enough, or once the first has waited long enough."""

    def __init__(self, most: int, seconds: float, key: Sequence[str], schema: T.StructType) -> None:
        self.most, self.wait, self.key, self.schema = most, int(seconds * 1000), list(key), schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.count = handle.getValueState("count", T.StructType([T.StructField("held", T.LongType()), T.StructField("flushes", T.LongType())]))

    def _emit(self, rows: list[tuple], flush: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.schema.names)
        return out.assign(flush=flush, place=range(len(rows)))

    def _counts(self) -> tuple[int, int]:
        return tuple(self.count.get()) if self.count.exists() else (0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, flushes = self._counts()
        for part in rows:
            fresh = list(part[self.schema.names].itertuples(index=False, name=None))
            while fresh:
                taken, fresh = fresh[: self.most - held], fresh[self.most - held :]
                if held == 0 and len(taken) < self.most:
                    self._wait(timerValues)
                if held + len(taken) < self.most:
                    self.held.appendList(taken)
                    held += len(taken)
                else:
                    yield self._emit([*self.held.get(), *taken] if held else taken, flushes)
                    self._forget()
                    held, flushes = 0, flushes + 1
        self.count.update((held, flushes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, flushes = self._counts()
        if held:
            yield self._emit(list(self.held.get()), flushes)
            self._forget()
            self.count.update((0, flushes + 1))

    def _wait(self, timers) -> None:
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait)

    def _forget(self) -> None:
        self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def flushed(rows: DataFrame, keys: Sequence[str], most: int = 50, seconds: float = 30.0) -> DataFrame:
    """The rows of a stream with flush, the number of the group of its key that a row goes on with, and its place in it.

    A group goes on when it has `most` rows, or `seconds` after its first row came; what is held survives a restart.
    Such a query waits for its timers, so it doesn't end by itself, with availableNow either.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("flush", T.LongType()), T.StructField("place", T.LongType())])
    return _processed(rows, keys, _Flush(most, seconds, keys, rows.schema), schema, "processingTime")


def last_versions(batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Of each key the row with the largest version."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])
