"""Similarity joins over unit vectors, exact or restricted to cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from .blocks import AnyEarlier, BestK, block_pairs, every_block, ints, matrix, tiled_any, tiled_best_k
from .ordering import top_per_key

PAIR = "qid long, id long, sim double"


def _pairs(qid, ids, sims) -> pa.Table:
    return pa.table({"qid": pa.array(qid, pa.int64()), "id": pa.array(ids, pa.int64()), "sim": pa.array(sims, pa.float64())})


def _two_sides(x: pa.Table, y: pa.Table):
    return matrix(x["v"]), ints(x["qid"]), matrix(y["v"]), ints(y["id"])


def top_k(
    queries: DataFrame, items: DataFrame, k: int = S.SEARCH_K, cell: str | None = None,
    earlier_only: bool = False, block_rows: int = S.VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` most similar items of every query: (qid, id, sim, rank).

    ``queries`` is (qid, v), ``items`` (id, v); with ``cell`` only equal cells meet, a
    query row per probed cell. Without, a task goes through its share of the items with one block of
    queries, and the shuffle before the final ranking carries k rows per query and share; with cells
    every pair of blocks yields its own best k. ``earlier_only`` counts items with an id below the query's.
    """
    if cell is None:
        def best(found: BestK) -> pa.Table:
            r, ids, sims = found.rows()
            return _pairs(found.qids[r], ids, sims)

        found = every_block(queries, items, lambda q, qid: BestK(q, qid, k, earlier_only), best, PAIR, block_rows)
        return top_per_key(found, ["qid"], [F.col("sim").desc(), F.col("id")], k, "rank")

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows == 0 or y.num_rows == 0:
            return _pairs([], [], [])
        q, qid, v, ids = _two_sides(x, y)
        r, c, sims = tiled_best_k(q, qid, v, ids, k, earlier_only)
        return _pairs(qid[r], ids[c], sims)

    found = block_pairs(queries, items, kernel, PAIR, "qid", "id", cell, block_rows)
    return top_per_key(found, ["qid"], [F.col("sim").desc(), F.col("id")], k, "rank")


def with_match(
    queries: DataFrame, items: DataFrame, floor: float, block_rows: int = S.VECTOR_BLOCK_ROWS,
    cell: str | None = None,
) -> DataFrame:
    """Ids of queries similar (>= ``floor``) to an item with a lower id.

    Only the fact is reported, one row per query and share of the items (with ``cell``: and block), never the pairs.
    """
    if cell is None:
        hits = lambda found: pa.table({"qid": pa.array(found.qids[found.rows()], pa.int64())})
        return every_block(queries, items, lambda q, qid: AnyEarlier(q, qid, floor), hits, "qid long", block_rows).distinct()

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows == 0 or y.num_rows == 0:
            return pa.table({"qid": pa.array([], pa.int64())})
        q, qid, v, ids = _two_sides(x, y)
        return pa.table({"qid": pa.array(qid[tiled_any(q, qid, v, ids, floor)], pa.int64())})

    return block_pairs(queries, items, kernel, "qid long", "qid", "id", cell, block_rows).distinct()


def within_groups(
    images: DataFrame, group: list[str], idx: str = "idx", v: str = "v", limit: int = S.LINKAGE_MAX,
    block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Cosine distance of every pair (i < j) inside groups of any size: (group, i, j, distance).

    Groups of at most ``limit`` images are one task's matrix. Bigger ones are cut into blocks
    that meet pair by pair, so no task holds more than two blocks, whatever a group holds.
    """
    kinds = dict(images.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "i long", "j long", "distance double"])
    sized = images.select(*group, idx, v)

    def rows(keys: dict, left, right, dist, i, j) -> pa.Table:
        out = {g: pa.array([value] * len(i), kind) for g, (value, kind) in keys.items()}
        return pa.table({**out, "i": left[i], "j": right[j], "distance": dist[i, j]})

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by(idx)
        ids, m = ints(t[idx]), matrix(t[v])
        keys = {g: (t[g][0].as_py(), t[g].type) for g in group}
        return rows(keys, ids, ids, np.clip(1.0 - m @ m.T, 0.0, 2.0), *np.triu_indices(len(ids), 1))

    def blocks(x: pa.Table, y: pa.Table) -> pa.Table:
        keys = {g: (x[g][0].as_py() if x.num_rows else None, x[g].type) for g in group}
        left, right = ints(x[idx]), ints(y["_j"])
        if not len(left) or not len(right):
            none = np.empty(0, np.int64)
            return rows(keys, none, none, np.empty((0, 0)), none, none)
        dist = np.clip(1.0 - matrix(x[v]) @ matrix(y["_w"]).T, 0.0, 2.0)
        return rows(keys, left, right, dist, *np.nonzero(left[:, None] < right[None, :]))

    sizes = sized.groupBy(F.struct(*group).alias("_album")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_album")
    tagged = sized.withColumn("_album", F.struct(*group))
    small = tagged.join(sizes, "_album", "left_anti").select(*group, idx, v)
    big = tagged.join(sizes, "_album", "left_semi")
    other = big.select(F.col("_album").alias("_album"), F.col(idx).alias("_j"), F.col(v).alias("_w"))
    return small.groupBy(*group).applyInArrow(whole, schema).unionByName(block_pairs(big, other, blocks, schema, idx, "_j", "_album", block_rows))
