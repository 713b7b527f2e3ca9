"""Keyed state with event-time timers: an expiring store, and keys seen first.

Both read the watermark of the batch themselves, so a late row is decided on and counted instead
of falling away unseen. The time that they work with is milliseconds, the unit of Spark's
watermarks and timers. State holds one small value per key until its timer, rows of one key pass
a task as a stream of Arrow batches, and the timers fire in the batch without data that ends an
``availableNow`` run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import tables

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What a missing version counts as.
NO_VERSION = -(2**63)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in the provider that state variables need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _timed(rows: DataFrame, key: str, time: str, version: str, delay: str) -> DataFrame:
    """key, version, and the time in milliseconds and microseconds. The watermark is kept, but no row is dropped by it.

    A row without a time is left out.
    """
    plain = rows.select(F.col(key).alias("key"), F.coalesce(F.col(version).cast("bigint"), F.lit(NO_VERSION)).alias("version"), F.col(time).cast("timestamp").alias("at"))
    marked = plain.where(F.col("at").isNotNull()).withWatermark("at", delay)
    return marked.select("key", "version", F.unix_millis("at").alias("ms"), F.unix_micros("at").alias("us"))


class _Store(StatefulProcessor):
    """The newest write of a key until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, version long")

    def _row(self, key, what: str, us: int | None, version: int | None, rows: int) -> pd.DataFrame:
        times = pd.array([us, version], dtype="Int64")
        return pd.DataFrame({"key": [key[0]], "what": [what], "us": times[:1], "version": times[1:], "rows": [rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, late, best = timerValues.getCurrentWatermarkInMs(), 0, None
        for part in rows:
            fresh = part[part["ms"] >= mark]
            late += len(part) - len(fresh)
            if len(fresh):
                # Of writes at one time the one with the largest version counts.
                top = max(zip(fresh["us"].tolist(), fresh["version"].tolist(), strict=True))
                best = top if best is None else max(best, top)
        if late:
            yield self._row(key, "late", None, None, late)
        if best is None:
            return
        held = self.newest.get()
        if held is None or best > tuple(held):
            self.newest.update(best)
            if held is None:  # a renewed entry is looked at again when its first timer fires
                self.handle.registerTimer(best[0] // 1000 + 1)
            yield self._row(key, "stored", *best, 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        if held[0] // 1000 >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(held[0] // 1000 + 1)
        else:
            self.newest.clear()
            yield self._row(key, "expired", *held, 1)

    def close(self) -> None:
        pass


class _Seen(StatefulProcessor):
    """Whether a key was seen, until it is forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, late, again, first = timerValues.getCurrentWatermarkInMs(), 0, 0, None
        for part in rows:
            fresh = part[part["ms"] >= mark]
            late += len(part) - len(fresh)
            again += len(fresh)
            if len(fresh):
                own = min(zip(fresh["us"].tolist(), fresh["version"].tolist(), strict=True))
                first = own if first is None else min(first, own)
        new = first is not None and self.until.get() is None
        if new:
            until = first[0] // 1000 + self.keep_ms
            self.until.update((until,))
            self.handle.registerTimer(until)
        us, version = pd.array([first[0] if new else None], dtype="Int64"), pd.array([first[1] if new else None], dtype="Int64")
        yield pd.DataFrame({"key": [key[0]], "us": us, "version": version, "late": [late], "repeated": [again - new]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_store(writes: DataFrame, key: str, time: str, version: str, ttl: str, path: str, checkpoint: str) -> DataFrame:
    """Work off a stream of feature writes; what the store holds then, a row per key that ever came.

    Columns: key, written_at and version of the live entry (null if there is none), and late, the
    writes that were older than ``ttl`` when they came. An entry expires when the newest write of
    the whole stream is more than ``ttl`` later; exactly that age still counts. An expired entry
    leaves the state by a timer. A key's newest write stays, of equal times the largest
    ``version`` (a whole number, null counting lowest).
    """
    spark = writes.sparkSession
    kind = writes.schema[key].dataType.simpleString()
    fields = f"key {kind}, what string, us bigint, version bigint, rows bigint"
    changes = _timed(writes, key, time, version, ttl).groupBy("key").transformWithStateInPandas(_Store(), fields, "Append", "EventTime")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        tables.put(batch.withColumn("seq", F.lit(batch_id).cast("bigint")), path, batch_id)

    with keyed_state(spark):
        tables.run_available(changes, on_batch, checkpoint)
    rows = tables.get(spark, path, fields + ", seq bigint")
    # In one batch a key is stored or expires, never both; each change counts, so the newest is the state.
    last = F.max_by(F.struct("what", "us", "version"), F.when(F.col("what") != "late", F.col("seq")))
    held = rows.groupBy("key").agg(last.alias("last"), F.coalesce(F.sum(F.when(F.col("what") == "late", F.col("rows"))), F.lit(0)).alias("late"))
    live = F.col("last.what") == "stored"
    version_held = F.when(live & (F.col("last.version") != NO_VERSION), F.col("last.version"))
    return held.select(F.col("key").alias(key), F.when(live, F.timestamp_micros("last.us")).alias("written_at"), version_held.alias("version"), "late")


def first_seen(rows: DataFrame, key: str, time: str, order: str, delay: str, keep_ms: int, path: str, checkpoint: str) -> DataFrame:
    """Work off a stream; each key's sightings as (key, seen_at, order), and how many rows were late or repeated.

    A row is late if it is more than ``delay`` older than the newest row of earlier batches; it is
    counted and otherwise ignored. The first row of a key that is not late (by time, then by the
    whole number ``order``) is a sighting. The key is forgotten ``keep_ms`` after it, once the
    watermark gets there, and can then be sighted anew; until then its rows are repeats.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    fields = f"key {kind}, us bigint, version bigint, late bigint, repeated bigint"
    seen = _timed(rows, key, time, order, delay).groupBy("key").transformWithStateInPandas(_Seen(keep_ms), fields, "Append", "EventTime")
    with keyed_state(spark):
        tables.run_available(seen, lambda batch, i: tables.put(batch, path, i), checkpoint)
    out = tables.get(spark, path, fields)
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias("seen_at"), F.nullif("version", F.lit(NO_VERSION)).alias(order), "late", "repeated")
