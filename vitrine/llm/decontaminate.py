"""Benchmark passages inside documents: size-partitioned MinHash containment search.

Test items are parted by size, documents by the power of two above their number of
shingles. A document of class ``c`` has a one-permutation signature of ``2^c / load`` bins,
so its length follows the document's and a short item inside a long text still shares
minima with it; the load of an item part is the largest at which an item that is contained
shares no minimum with chance ``MISS`` at most. The bins of larger loads are unions of those
of smaller ones, so one list of minima, each with the largest load at which it is one,
serves all parts. Items too short for any load meet all shingles. Candidates are then
checked on the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SHINGLE_WORDS, SIMILARITY_PERCENT, texts, words

LOADS = (0.5, 1.0, 2.0, 4.0, 8.0)
MISS = 1e-6
#: Item minima are broadcast up to this many rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Candidate items that are checked against a document at once.
LIST_ITEMS = 256


def least_size(load: float, percent: int, miss: float) -> int:
    """Smallest number of item shingles at which bins of that load find a contained item."""
    p = (1 - math.exp(-load)) / load
    shared = math.ceil(math.log(miss) / math.log(1 - p))
    return math.ceil(100 * shared / percent)


def _strings(df: DataFrame, k: int) -> DataFrame:
    """Adds ``s``: the distinct shingles of column ``w`` as texts (words joined by a space)."""
    n = F.size("w")
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *(F.get(F.col("w"), i + j) for j in range(k))))
    return df.withColumn("s", F.array_distinct(F.when(n >= k, many).when(n > 0, F.array(F.concat_ws(" ", "w"))).otherwise(F.expr("cast(array() as array<string>)"))))


def _hashes(df: DataFrame, k: int) -> DataFrame:
    """Adds ``h``: 64-bit hashes of the shingles of column ``w``, sorted, repeats included."""
    df = df.withColumn("_wh", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("_wh")
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(F.col("_wh"), i + j) for j in range(k))))
    return df.withColumn("h", F.sort_array(F.when(n >= k, many).when(n > 0, F.array(F.xxhash64("_wh"))).otherwise(F.expr("cast(array() as array<bigint>)")))).drop("_wh")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = SIMILARITY_PERCENT, k: int = SHINGLE_WORDS,
                 key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """key, item, n_item, n_shared, containment: the pairs where the document holds the item.

    An item is held when ``percent`` of its distinct shingles or more are in the document.
    Texts of fewer than ``k`` words are one shingle, so a shorter item is found only in a
    text equal to it; null and empty texts hold nothing and are held by nothing. Rows
    without an id take no part. Of rows that repeat ids the best pair counts.
    """
    items = texts(benchmark, item).where(F.col(item).isNotNull())
    items = items.select(F.col(item), words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = _hashes(_strings(items, k), k).select(item, "s", "h", F.size("s").alias("n_item"))
    sizes = [least_size(load, percent, MISS) for load in LOADS]
    # The part of an item: how many of the loads it is large enough for (0: meets all shingles).
    part = sum((F.col("n_item") >= n).cast("int") for n in sizes)
    wanted = items.select(item, F.explode_outer("h").alias("h"), part.alias("part")).distinct()
    facts = wanted.agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least"), F.max("part").alias("most")).first()
    rows, least, most = facts["n"], facts["least"] or 0, facts["most"] or 0

    src = texts(docs, key).where(F.col(key).isNotNull())
    signed = _hashes(src.select(F.col(key), words(F.col("text")).alias("w")), k)
    signed = signed.select(key, "h", F.ceil(F.log2(F.size("h"))).cast("int").alias("_c"))

    def depth(x: Column, i: Column) -> Column:
        before = F.get(F.col("h"), i - 1)
        fresh = F.when((i == 0) | (before != x), F.lit(1)).otherwise(F.lit(0))
        # 2^c / load bins: the top c - log2(load) bits. Larger loads have fewer, nested bins.
        out = F.lit(least)
        for load in LOADS[least:most]:
            shift = F.lit(64 + int(math.log2(load))) - F.col("_c")
            first = (i == 0) | (shift < 64) & (_shift(before, shift) != _shift(x, shift))
            out = out + F.when(first, F.lit(1)).otherwise(F.lit(0))
        return F.when(fresh == 1, out).otherwise(F.lit(-1))

    if least:
        # The finest bins needed: a hash that is no minimum there is never sent.
        load = LOADS[least - 1]
        shift = F.lit(64 + int(math.log2(load))) - F.col("_c")
        minima = F.filter("h", lambda x, i: (i == 0) | (shift < 64) & (_shift(F.get(F.col("h"), i - 1), shift) != _shift(x, shift)))
        # The first hash of each finest bin; whether it is first in a larger bin shows among these alone.
        signed = signed.select(key, minima.alias("h"), "_c")
    # Repeats and non-minima fall at -1 or below their part. A plain explode would infer a filter on
    # the array, and pushing that down copies whole expressions into the lambdas.
    sent = signed.select(key, F.explode_outer(F.transform("h", lambda x, i: F.struct(x.alias("h"), depth(x, i).alias("depth")))).alias("m")).select(key, "m.*")
    right = wanted.select(item, F.col("h"), "part")
    right = F.broadcast(right) if rows <= BROADCAST_ROWS else right
    pairs = cut(sent.where("depth >= 0").join(right, "h").where("depth >= part").select(key, item).distinct())

    # A document's candidates are checked in lists of some LIST_ITEMS, however many it has.
    lists = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / LIST_ITEMS).alias("_lists"))
    full = pairs.join(lists, key).withColumn("_list", F.pmod(F.xxhash64(item), F.col("_lists"))).join(items.select(item, "s", "n_item"), item)
    full = full.groupBy(key, "_list").agg(F.collect_list(F.struct(item, "s", "n_item")).alias("_items"))
    held = _strings(src.join(full, key).select(key, "_items", words(F.col("text")).alias("w")), k)
    held = held.select(key, F.explode("_items").alias("i"), "s")
    held = held.select(key, f"i.{item}", "i.n_item", F.size(F.array_intersect("i.s", "s")).alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = held.groupBy(key, item).agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b"))
    return best.select(key, item, F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), "b.containment")


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that hold an item; rows without an id stay, and columns of any name."""
    held = contaminated(docs, benchmark, key=key, **how).select(F.col(key).alias("held")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("id"))
    return rows.join(held, F.col("id") == F.col("held"), "left_anti").select("row.*")
