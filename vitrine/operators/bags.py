"""Set operations that count copies, and totals over several groupings at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of one row that one task gives out.
BLOCK_COPIES = 100_000


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row of both tables with ``in_left`` and ``in_right``, how often it is in them. Nulls equal nulls.

    Copies are counted before the shuffle, so a row with any number of them travels once a task.
    """
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return both.groupBy(*left.columns).agg(F.count_if(F.col("_side") == 0).alias("in_left"), F.count_if(F.col("_side") == 1).alias("in_right"))


def expanded(rows: DataFrame, copies: Column, block: int = BLOCK_COPIES) -> DataFrame:
    """Each row as often as ``copies`` says. Rows with very many copies are given out by many tasks."""
    columns = [c for c in rows.columns if c not in ("in_left", "in_right")]
    wanted = rows.select(*columns, copies.cast("bigint").alias("_copies")).where("_copies > 0")
    few, many = wanted.where(F.col("_copies") <= block), wanted.where(F.col("_copies") > block)
    blocks = many.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / block))))
    part = blocks.withColumn("_copies", F.least(F.lit(block).cast("bigint"), F.col("_copies") - F.col("_block") * block)).repartition("_block", *columns).drop("_block")
    given = few.unionByName(part).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return given.select(*columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables, as often as in the one that has fewer of them."""
    return expanded(counted(left, right), F.least("in_left", "in_right"))


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, each copy in ``right`` taking one away."""
    return expanded(counted(left, right), F.col("in_left") - F.col("in_right"))


def grouping_sets(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], distinct: str, value: str) -> DataFrame:
    """Totals for several groupings: dims (null where not grouped by), grouping_id, rows, distinct_count, highest, lowest.

    ``grouping_id`` has a bit per dimension, the first one highest, 1 where it is not grouped by.
    Rows are first added up per dims and value of ``distinct``; these, not the rows, are copied
    into the groupings. Distinct values are then counted in two steps: one row per group and value,
    dealt by both, and their number per group. Null values of ``distinct`` are not counted.
    """
    base = df.groupBy(*dims, F.col(distinct).alias("_d")).agg(F.count(F.lit(1)).alias("_rows"), F.max(value).alias("_high"), F.min(value).alias("_low"))
    ids = [sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in s) for s in sets]
    copied = base.withColumn("grouping_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    for i, c in enumerate(dims):
        bit = 1 << (len(dims) - 1 - i)
        copied = copied.withColumn(c, F.when(F.col("grouping_id").bitwiseAND(bit) == 0, F.col(c)))
    once = copied.groupBy("grouping_id", *dims, "_d").agg(F.sum("_rows").alias("_rows"), F.max("_high").alias("_high"), F.min("_low").alias("_low"))
    return once.groupBy("grouping_id", *dims).agg(
        F.sum("_rows").alias("rows"), F.count("_d").alias("distinct_count"), F.max("_high").alias("highest"), F.min("_low").alias("lowest"))


def cube(df: DataFrame, dims: Sequence[str], distinct: str, value: str) -> DataFrame:
    """``grouping_sets`` for every subset of ``dims``."""
    sets = [[c for i, c in enumerate(dims) if n >> i & 1] for n in range(1 << len(dims))]
    return grouping_sets(df, dims, sets, distinct, value)
