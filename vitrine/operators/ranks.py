"""Ranks, tiles and neighbours over whole tables or hot keys, without a window over all their rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from .ordering import numbered, parts_for, place, split_points


def _chunk(df: DataFrame, column: str, chunk_rows: int) -> Column:
    parts = parts_for(df.count(), chunk_rows)
    return place(F.col(column), split_points(df, column, parts)) if parts > 1 else F.lit(0)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """keys, value, and for each distinct value: ``before`` (rows below it), ``same`` (rows of it), ``dense`` and ``rows`` (all of its keys).

    Rows of one value are counted before they are shuffled, so a value that a third of the rows
    share is one row here. Nulls are the lowest value; null keys are a key.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("same"))
    cut = counted.withColumn("_chunk", _chunk(counted, value, chunk_rows))
    sums = cut.groupBy(*keys, "_chunk").agg(F.sum("same").alias("_n"), F.count(F.lit(1)).alias("_d"))
    all_before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
        F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_d").over(all_before), F.lit(0)).alias("_dense_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("rows"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(F.col(value).asc_nulls_first())
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("same").over(upto), F.lit(0))).withColumn("_dense", F.row_number().over(within))
    on = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        on = on & local[k].eqNullSafe(F.col(f"_key{i}"))
    out = local.join(offsets, on)
    return out.select(*[local[k] for k in keys], value, (F.col("_rows_before") + F.col("_local")).alias("before"), "same", (F.col("_dense_before") + F.col("_dense")).alias("dense"), "rows")


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """The tile of a row, of ``tiles`` tiles whose sizes differ by one at most, larger ones first."""
    size, more = F.floor(rows / tiles), rows % tiles
    large = more * (size + 1)
    first = F.floor((position - 1) / (size + 1)) + 1
    return F.when(position <= large, first).otherwise(more + F.floor((position - large - 1) / size) + 1).cast("bigint")


def ranked(df: DataFrame, keys: Sequence[str], value: str, tie: str, tiles: int = 4, chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """``df`` with row_number, rank, dense_rank, percent_rank, cume_dist and ntile by ascending ``value`` in its keys.

    Nulls come first. Rows of one value are numbered by ``tie``, which should tell them apart.
    """
    spots = value_ranks(df, keys, value, chunk_rows).select(
        *[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col(value).alias("_rv"), F.col("before").alias("_before"), F.col("same").alias("_same"), F.col("dense").alias("dense_rank"), F.col("rows").alias("_rows"))
    # Ties are numbered chunk by chunk along ``tie``, so that a hot value is no single task either.
    placed = numbered(df, [*keys, value], [F.col(tie)], "_among", _chunk(df, tie, chunk_rows))
    on = F.col(value).eqNullSafe(F.col("_rv"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    out = placed.join(spots, on)
    position = F.col("_before") + F.col("_among")
    return out.select(
        *df.columns, position.alias("row_number"), (F.col("_before") + 1).alias("rank"), "dense_rank",
        F.when(F.col("_rows") > 1, F.col("_before") / (F.col("_rows") - 1)).otherwise(0.0).alias("percent_rank"),
        ((F.col("_before") + F.col("_same")) / F.col("_rows")).alias("cume_dist"), tile(position, F.col("_rows"), tiles).alias("ntile"))


def neighbours(df: DataFrame, keys: Sequence[str], position: str, take: Mapping[str, tuple[str, int]], chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """``df`` with columns of rows further on (offset above 0, a lead) or back (below 0, a lag).

    ``take`` maps a new column to (column, offset). ``position`` numbers the rows of each key from
    1 on without gaps, as ``ranked`` and ``ordering.numbered`` do. Rows within an offset of a
    chunk's border are copied into the chunk beyond it.
    """
    back, on = max(0, *(-o for _, o in take.values())), max(0, *(o for _, o in take.values()))
    if max(back, on) > chunk_rows:
        raise ValueError(f"offsets of {max(back, on)} rows need chunks of as many")
    at = lambda shift: F.floor((F.col(position) + shift) / chunk_rows)
    spread = df.withColumn("_own", at(0)).withColumn("_chunk", F.explode(F.array_distinct(F.array(at(0), at(back), at(-on)))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    for out, (column, offset) in take.items():
        spread = spread.withColumn(out, F.lead(column, offset).over(w) if offset > 0 else F.lag(column, -offset).over(w))
    return spread.where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk")
