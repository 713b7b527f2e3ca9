"""As-of joins, interval joins and sessions, also where one key holds most of the rows.

A table is cut along time into chunks, and every window runs over one key in one chunk. What a
chunk needs from the ones before it, a last row or an open session, travels as one row per key
and chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from .ordering import parts_for, place, split_points


def time_chunk(tables: Sequence[tuple[DataFrame, str]], column: Column, chunk_rows: int) -> Column:
    """Chunk number along the times of several tables, some ``chunk_rows`` rows each if times are spread."""
    times = None
    for df, name in tables:
        own = df.select(F.col(name).alias("t"))
        times = own if times is None else times.unionByName(own)
    parts = parts_for(times.count(), chunk_rows)
    return place(column, split_points(times, "t", parts)) if parts > 1 else F.lit(0)




def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, take: Mapping[str, str], tie: Sequence[str] = (), chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """Each left row with columns of the latest right row of its keys at or before its time.

    ``take`` maps new columns to columns of ``right``. Of right rows at one time the largest in
    ``tie`` counts. Keys compare as in a join: a null matches nothing. Left rows without a match,
    a key or a time stay, with nulls. Both sides are merged by time within (keys, chunk); the
    last right row of each chunk is handed on to later chunks of its keys.
    """
    n = len(keys)
    names = [f"_k{i}" for i in range(n)]
    tied = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("none"))
    found = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(take.values())])
    whole = F.col(time).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rows = left.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(time).alias("_t"), whole.alias("_whole"), F.struct(*left.columns).alias("_row"))
    marks = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(right_time).alias("_t"), tied.alias("_tie"), found.alias("_found"))
    for a in names:
        marks = marks.where(F.col(a).isNotNull())
    chunk = time_chunk([(rows, "_t"), (marks, "_t")], F.col("_t"), chunk_rows)
    both = rows.where("_whole").unionByName(marks, allowMissingColumns=True).withColumn("_chunk", chunk)
    right_first = F.col("_found").isNull()
    within = Window.partitionBy(*names, "_chunk").orderBy("_t", right_first, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_found", F.last("_found", ignorenulls=True).over(within)).where(F.col("_row").isNotNull())
    # One row per keys and chunk: the last right row of all chunks before it.
    newest = F.max_by("_found", F.when(F.col("_found").isNotNull(), F.struct("_t", "_tie")))
    earlier = Window.partitionBy(*names).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*names, "_chunk").agg(newest.alias("_last")).withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    merged = near.join(carried, [*names, "_chunk"], "left").select("_row", F.coalesce("_found", "_before").alias("_found"))
    out = merged.unionByName(rows.where("NOT _whole").select("_row", F.lit(None).cast(merged.schema["_found"].dataType).alias("_found")))
    return out.select("_row.*", *[F.col(f"_found.c{i}").alias(a) for i, a in enumerate(take)])


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows of equal keys whose spans overlap, ends included: columns ``left`` and ``right`` (structs).

    Spans are (start, end) columns of whole numbers, such as microseconds; a point names one
    column twice. Rows with a null key or end, or that end before they start, match nothing.

    Bins are dyadic: level v has bins of ``width * 2^v``. A span lives on the lowest level whose
    bins are as long as it, in at most two bins, and visits the higher levels on which the other
    side has spans. Pairs meet where the longer one lives, and count only in the bin in which
    the later one starts: once. A span over any number of narrow bins has two copies a level.
    ``width`` should be near the shortest usual span; it does not change the result.
    """

    def side(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = (F.col(c).cast("bigint") for c in span)
        names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
        rows = df.select(*names, start.alias("_s"), end.alias("_e"), F.struct(*df.columns).alias("_row")).where("_s <= _e")
        for i in range(len(keys)):
            rows = rows.where(F.col(f"_k{i}").isNotNull())
        over = F.expr(f"(_e - _s - 1) div {width}L")
        return rows.withColumn("_own", F.when(over > 0, F.length(F.bin(over))).otherwise(0))

    def bin_of(at: str) -> Column:
        size = f"shiftleft({width}L, _level)"
        return F.expr(f"({at} - pmod({at}, {size})) div {size}")

    def binned(rows: DataFrame, levels: Column) -> DataFrame:
        spread = rows.withColumn("_level", F.explode(levels))
        return spread.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of("_s"), bin_of("_e")))))

    a, b = side(left, left_span), side(right, right_span)
    own = F.array(F.col("_own"))
    high = lambda other: F.filter(F.array(*[F.lit(v) for v in _levels(other)]).cast("array<int>"), lambda v: v > F.col("_own"))
    homes_a, homes_b = binned(a, own), binned(b, own)

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        places = ["_level", "_bin", *[f"_k{i}" for i in range(len(keys))]]
        x = x.select(*places, F.col("_s").alias("_ls"), F.col("_e").alias("_le"), F.col("_row").alias("left"))
        y = y.select(*places, F.col("_s").alias("_rs"), F.col("_e").alias("_re"), F.col("_row").alias("right"))
        met = x.join(y, places).where("_ls <= _re AND _rs <= _le")
        return met.where(F.col("_bin") == bin_of("greatest(_ls, _rs)")).select("left", "right")

    return pairs(homes_a, homes_b.unionByName(binned(b, high(a)))).unionByName(pairs(binned(a, high(b)), homes_b))


def _levels(rows: DataFrame) -> list[int]:
    """The levels on which spans live: at most 63 numbers."""
    return sorted(r["_own"] for r in rows.select("_own").distinct().collect())


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str, value: str, chunk_rows: int = S.CHUNK_ROWS) -> DataFrame:
    """Sessions per keys: start, last (times of the first and last row), rows, highest and lowest value.

    A row that comes ``gap`` or more after the one before it starts a session. Rows without a time
    belong to none; null keys are a key. Sessions are found inside (keys, chunk); the first and last
    of each chunk, and only they, are then merged over the borders.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names, strict=True)], F.col(time).cast("timestamp").alias("_t"), F.col(value).alias("_v")).where(F.col("_t").isNotNull())
    step = F.expr(f"INTERVAL {gap}")
    cut = rows.withColumn("_chunk", time_chunk([(rows, "_t")], F.col("_t"), chunk_rows))
    within = Window.partitionBy(*names, "_chunk").orderBy("_t")
    new = F.coalesce((F.col("_t") >= F.lag("_t").over(within) + step).cast("int"), F.lit(1))
    marked = cut.withColumn("_new", new).withColumn("_id", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = marked.groupBy(*names, "_chunk", "_id").agg(
        F.min("_t").alias("start"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("rows"), F.max("_v").alias("highest"), F.min("_v").alias("lowest"))
    local = local.withColumn("_border", (F.col("_id") == 1) | (F.col("_id") == F.max("_id").over(Window.partitionBy(*names, "_chunk"))))
    across = Window.partitionBy(*names).orderBy("start")
    borders = local.where("_border")
    apart = F.coalesce((F.col("start") >= F.lag("last").over(across) + step).cast("int"), F.lit(1))
    joined = borders.withColumn("_apart", apart).withColumn("_id", F.sum("_apart").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = joined.groupBy(*names, "_id").agg(
        F.min("start").alias("start"), F.max("last").alias("last"), F.sum("rows").alias("rows"), F.max("highest").alias("highest"), F.min("lowest").alias("lowest"))
    columns = [*names, "start", "last", "rows", "highest", "lowest"]
    out = local.where("NOT _border").select(*columns).unionByName(merged.select(*columns))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, names, strict=True)], *columns[len(names):])
