"""Event-time windows and sessions: the closed ones, from a stream or from a whole table.

A window is closed when the watermark, the newest time less the allowed delay, has reached its
end. The stream emits it then, once, and drops later rows of it; state holds open windows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def _totals(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.max(value).alias("highest"), F.min(value).alias("lowest")]


def _bounds(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window"])


def _marked(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())


def watermark(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """One row, ``mark``: the newest time of a table less ``delay``, in whole milliseconds as Spark keeps it."""
    newest = _marked(rows, time).agg(F.timestamp_millis(F.max(F.unix_millis(time))).alias("newest"))
    return newest.select((F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("mark"))


def _closed(grouped: DataFrame, rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Windows whose end the watermark has reached; the mark is one value."""
    mark = watermark(rows, time, delay).first()["mark"]
    return _bounds(grouped).where(F.col("end") <= F.lit(mark)) if mark is not None else _bounds(grouped).where(F.lit(False))


def closed_windows(rows: DataFrame, keys: list[str], time: str, value: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """start, end, keys, rows, highest and lowest value of the closed windows of a whole table, where nothing is late."""
    timed = _marked(rows, time)
    return _closed(timed.groupBy(F.window(time, width, slide).alias("window"), *keys).agg(*_totals(value)), rows, time, delay)


def closed_sessions(rows: DataFrame, keys: list[str], time: str, value: str, gap: str, delay: str) -> DataFrame:
    """As ``closed_windows``, for sessions: they end ``gap`` after their last row, and rows nearer than that join them."""
    timed = _marked(rows, time)
    return _closed(timed.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*_totals(value)), rows, time, delay)


def stream_windows(rows: DataFrame, keys: list[str], time: str, value: str, width: str, delay: str, path: str, checkpoint: str, slide: str | None = None) -> DataFrame:
    """The windows that a stream has closed so far; rows of a window that was closed before they came are dropped."""
    timed = _marked(rows, time).withWatermark(time, delay)
    return _run(timed.groupBy(F.window(time, width, slide).alias("window"), *keys).agg(*_totals(value)), path, checkpoint)


def stream_sessions(rows: DataFrame, keys: list[str], time: str, value: str, gap: str, delay: str, path: str, checkpoint: str) -> DataFrame:
    """The sessions that a stream has closed so far."""
    timed = _marked(rows, time).withWatermark(time, delay)
    return _run(timed.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*_totals(value)), path, checkpoint)


def _run(grouped: DataFrame, path: str, checkpoint: str) -> DataFrame:
    out = _bounds(grouped)
    fields = ", ".join(f"{n} {k}" for n, k in out.dtypes)
    tables.run_available(out, lambda batch, i: tables.put(batch, path, i), checkpoint)
    return tables.get(out.sparkSession, path, fields)
