"""Cells on two levels: any number of them, without a task that holds all centroids.

A small table of coarse centroids is broadcast; each coarse cell has its own fine centroids, which
stay a distributed table. A vector meets the fine centroids of its nearest coarse cells only, block
by block, so neither training nor placing multiplies with all centroids, and their number is
⌊√n⌋ at every size. A coarse cell that holds much of the table has as many more fine cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.vectors import as_double, l2_normalize
from ..session import cut
from .blocks import block_pairs, ints, matrix
from .cells import TRAIN_PER_CELL, _drawn, _share, assign, best_coded, exact_order, train_cells
from .ordering import top_per_key
from .similarity import PAIR, _pairs, top_k

#: Coarse cells whose fine centroids a query looks at.
COARSE_PROBES = 6


@dataclass
class CellTree:
    """Coarse centroids, and the fine ones as (id, v, cell): their number, vector and coarse cell."""

    coarse: np.ndarray
    fine: DataFrame

    def shares(self) -> DataFrame:
        """Fine centroids per coarse cell."""
        return self.fine.groupBy("cell").count()


def train(items: DataFrame, cells: int | None = None, iterations: int = 2, per_cell: int = TRAIN_PER_CELL) -> CellTree:
    """A tree over (id, v) with about ``cells`` fine cells, ⌊√n⌋ by default, and their square root of coarse ones.

    Training looks at about ``per_cell`` rows per fine cell, drawn by the hash of their id. Fine
    centroids start from rows drawn in the same way, each coarse cell in proportion to its rows,
    and move to the mean of their rows ``iterations`` times. A fine cell is named by the id of the
    row that it started from.
    """
    n = items.count()
    cells = max(1, cells or math.isqrt(n))
    few = math.isqrt(cells - 1) + 1
    coarse = train_cells(items, few, per_cell=per_cell)
    sample = cut(assign(_drawn(items.select("id", "v"), cells * per_cell, n), coarse))
    total = sample.count()
    # Each row is a start with chance cells / total, and the first row of each coarse cell is one.
    draw = F.pmod(F.xxhash64(F.lit(31), "id"), F.lit(1 << 31))
    firsts = sample.groupBy("cell").agg(F.min_by("id", draw).alias("id"))
    starts = sample.where(draw < int(cells / total * (1 << 31))).select("cell", "id").unionByName(firsts).distinct()
    fine = cut(sample.join(starts, ["cell", "id"]).select("id", as_double(F.col("v")).alias("v"), "cell"))
    for _ in range(iterations):
        nearest = top_k(sample.withColumnRenamed("id", "qid"), fine, 1, "cell").select("qid", F.col("id").alias("fine"))
        moved = sample.join(nearest, sample["id"] == nearest["qid"]).groupBy("fine").agg(
            vector_to_array(Summarizer.mean(array_to_vector(as_double(F.col("v"))))).alias("mean"))
        fine = cut(fine.join(moved, fine["id"] == moved["fine"], "left").select("id", F.coalesce(l2_normalize(F.col("mean")), "v").alias("v"), "cell"))
    return CellTree(coarse, fine)


def place(df: DataFrame, tree: CellTree, key: str = "id", probes: int = 1, coarse_probes: int = 1) -> DataFrame:
    """``df`` (key, v and others) with ``cell``: a row per nearest fine cell, ``probes`` of them,
    looked for in the ``coarse_probes`` nearest coarse cells; ``near`` is its centroid's product."""
    near = assign(df.select(F.col(key).alias("qid"), "v"), tree.coarse, coarse_probes)
    found = top_k(near, tree.fine, probes, "cell").select(F.col("qid").alias(key), F.col("id").alias("cell"), "sim")
    return df.join(found, key).withColumnRenamed("sim", "near")


def search(
    queries: DataFrame, items: DataFrame, tree: CellTree, k: int = S.SEARCH_K,
    probes: int = S.PROBES, coarse_probes: int = COARSE_PROBES, block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Top-k of (qid, v) over placed (id, v, cell): exact products inside the ``probes`` nearest fine cells."""
    placed = place(queries.select("qid", "v"), tree, "qid", probes, coarse_probes)
    return top_k(placed, items.select("id", "v", "cell"), k, "cell", block_rows=block_rows)


def residuals(items: DataFrame, tree: CellTree) -> DataFrame:
    """(id, cell, v minus its fine centroid) of placed items."""
    centroids = tree.fine.select(F.col("id").alias("cell"), F.col("v").alias("centre"))
    return items.join(centroids, "cell").select("id", "cell", F.zip_with(as_double(F.col("v")), "centre", lambda a, b: a - b).alias("v"))


def pq_search(
    queries: DataFrame, coded: DataFrame, tree: CellTree, book: np.ndarray, k: int = S.SEARCH_K, probes: int = S.PROBES,
    coarse_probes: int = COARSE_PROBES, items: DataFrame | None = None, refine: int = 4, block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Top-k by quantised scores over codes of residuals; with ``items`` the best ``k * refine`` are re-ranked exactly.

    An item's score is the product with its cell's centroid, known from placing the query, plus
    one table look-up per sub-vector.
    """
    shared = _share(queries.sparkSession, book)
    wide = k * refine if items is not None else k
    placed = place(queries.select("qid", "v"), tree, "qid", probes, coarse_probes)

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows == 0 or y.num_rows == 0:
            return _pairs([], [], [])
        q, codes, ids = matrix(x["v"]), matrix(y["codes"], np.int64), ints(y["id"])
        qid = ints(x["qid"])
        r, c, scores = best_coded(q, x["near"].to_numpy(), qid, codes, ids, shared.value, wide)
        return _pairs(qid[r], ids[c], scores)

    found = block_pairs(placed, coded, kernel, PAIR, "qid", "id", "cell", block_rows)
    best = top_per_key(found, ["qid"], [F.col("sim").desc(), F.col("id")], wide, "rank")
    return best if items is None else exact_order(best, queries, items, k)
