"""Ordered operators whose tasks stay small even when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of every key.

    The ``row_number() <= k`` shape lets Spark put a group limit in front of the shuffle,
    so a hot key sends at most ``k`` rows per map task.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_per_key(df, keys, order, 1)


def row_chunk(column: str, rows: int = S.CHUNK_ROWS) -> Column:
    """Order-preserving chunk of a whole-number row position."""
    return F.floor(F.col(column) / rows)


def split_points(df: DataFrame, column: str, parts: int = 64) -> list:
    """At most ``parts`` values of a sortable column, in order, that cut it evenly.

    They are the values that win a hash draw inside each of ``parts`` hash buckets: an even
    draw over distinct values, the same on every run.
    """
    bucket = F.pmod(F.xxhash64(F.lit(11), F.col(column)), F.lit(parts))
    drawn = (
        df.where(F.col(column).isNotNull())
        .groupBy(bucket.alias("b"))
        .agg(F.max_by(column, F.xxhash64(F.lit(29), F.col(column))).alias("v"))
        .select("v")
        .collect()
    )
    return sorted({r["v"] for r in drawn})


def sampled_chunk(df: DataFrame, column: str, parts: int = 64) -> Column:
    """Order-preserving chunk of any sortable column, by its split points."""
    return place(F.col(column), split_points(df, column, parts))


def place(column: Column, bounds: Sequence) -> Column:
    """How many of the sorted ``bounds`` are not above a value, by halving; 0 for a null."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(bounds[middle]), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def parts_for(rows: int, chunk_rows: int, most: int = 1_024) -> int:
    """How many chunks a table of so many rows is cut into."""
    return max(1, min(most, -(-rows // chunk_rows)))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    chunk: Column,
) -> DataFrame:
    """``row_number()`` per key, computed chunk by chunk.

    ``chunk`` must not decrease along ``order``. Rows are sorted per (key, chunk); the
    number of rows in earlier chunks, a small counted table, is then added. With no keys
    this numbers the whole table without pulling it into one task.
    """
    keys = list(keys)
    tagged = df.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_key_{c}") for c in keys], F.col("_chunk").alias("_c"), "_before")
    )
    local = tagged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    )
    match = F.col("_chunk").eqNullSafe(F.col("_c"))
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return (
        local.join(counts, match)
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_c", "_local", "_before", *[f"_key_{c}" for c in keys])
    )


def previous_mean(df: DataFrame, order: str, value: str, out: str, width: int) -> DataFrame:
    """Mean of the ``width`` earlier rows in a table ordered by a dense row number.

    Chunks carry copies of the rows just before them, so every chunk can be framed alone.
    """
    rows = S.CHUNK_ROWS
    own = F.floor(F.col(order) / rows)
    reach = F.floor((F.col(order) + width) / rows)
    spread = df.withColumn("_own", own).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(own, reach)))
    )
    w = Window.partitionBy("_chunk").orderBy(order).rowsBetween(-width, -1)
    return (
        spread.withColumn(out, F.avg(value).over(w))
        .where(F.col("_chunk") == F.col("_own"))
        .drop("_chunk", "_own")
    )
