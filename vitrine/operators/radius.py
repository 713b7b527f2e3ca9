"""Threshold joins that leave out what cannot match: cells with a radius, and the angle between.

A cell's radius is the largest angle between its centroid and one of its vectors. A query further
from the centroid than that radius plus the angle of the threshold has no match in the cell, so
cells are ruled out without losing a match. On clustered vectors few cells are left; where vectors
have no neighbours nearly all are, and then blocks of everything are the cheaper way to the
same rows (``BallCells.pays``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..session import cut
from .blocks import list_column, matrix
from .cells import _share, assign, cell_count, train_cells

#: Similarities are rounded to nine decimals; angles near 0 and 180 degrees lose half the digits.
SLACK = 1e-6
#: From this share of all comparisons on, cells are not worth their copies.
WORTH = 0.6
#: Nor are they when a query is copied to more cells than this, on the average.
MOST_COPIES = 64
#: Queries whose cells a task writes out at once.
SLICE_ROWS = 256


@dataclass
class BallCells:
    """Items (id, v, cell), and queries (qid, v, cell): a row per cell that may hold a match."""

    items: DataFrame
    visits: DataFrame
    compared: int
    every: int
    copies: float = 0.0

    @property
    def pays(self) -> bool:
        return self.compared < WORTH * self.every and self.copies <= MOST_COPIES


def build(queries: DataFrame, items: DataFrame, floor: float, cells: int | None = None) -> BallCells:
    """Cells of (id, v) and the visits of (qid, v) for similarities of ``floor`` (above 0) or more.

    Vectors are taken to be of length one. Those that are not are in a cell of their own, -1, that
    every query visits, and visit every cell, so nothing is lost with them either. The visits are
    counted before any is written; where they do not pay they stay a plan.
    """
    n = items.count()
    most = max(1, S.BROADCAST_BYTES // (8 * len(items.select("v").first()["v"]) + 8)) if n else 1
    if not n:
        return BallCells(items.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), 0, 0)
    centres = train_cells(items.select("id", "v"), min(cells or cell_count(n), most))
    turned = list(range(len(centres)))

    def angles(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(rows @ c.T, -1.0, 1.0))

    def uneven(rows: np.ndarray) -> np.ndarray:
        return np.abs(np.linalg.norm(rows, axis=1) - 1) > 1e-9

    shared = _share(items.sparkSession, centres)

    def measured(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                v, cell = matrix(t["v"]), t["cell"].to_numpy()
                own = np.arccos(np.clip((v * shared.value[cell]).sum(axis=1), -1.0, 1.0))
                cell = np.where(uneven(v), -1, cell)
                yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), t["v"].combine_chunks(), pa.array(cell, pa.int32()), pa.array(own)], names=["id", "v", "cell", "angle"])

    kinds = dict(items.dtypes)
    placed = cut(assign(items.select("id", "v"), centres).mapInArrow(measured, f"id {kinds['id']}, v {kinds['v']}, cell int, angle double"))
    facts = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    reach = math.acos(min(1.0, floor)) + SLACK
    limits = np.array([facts[c]["radius"] + reach if c in facts else -1.0 for c in turned])
    odd = -1 in facts

    def nearby(batches):
        for b in batches:
            for start in range(0, b.num_rows, SLICE_ROWS):
                t = pa.Table.from_batches([b.slice(start, SLICE_ROWS)])
                v = matrix(t["v"])
                near = (angles(v, shared.value) <= limits[None, :]) | (uneven(v)[:, None] & (limits >= 0)[None, :])
                yield t, v, near

    def counting(batches):
        total, rows = np.zeros(len(limits), np.int64), 0
        for _, v, near in nearby(batches):
            total, rows = total + near.sum(axis=0), rows + len(v)
        if rows:
            cells_, n_ = [*turned, *([-1] if odd else []), -2], [*total.tolist(), *([rows] if odd else []), rows]
            yield pa.RecordBatch.from_arrays([pa.array(cells_, pa.int32()), pa.array(n_, pa.int64())], names=["cell", "n"])

    def visiting(batches):
        for t, v, near in nearby(batches):
            r, c = np.nonzero(near)
            if odd:
                r, c = np.append(r, np.arange(len(v))), np.append(c, np.full(len(v), -1))
            qid, cell = pa.array(t["qid"].to_numpy()[r]), pa.array(c, pa.int32())
            for start in range(0, len(r), 8192):
                part = slice(start, start + 8192)
                yield pa.RecordBatch.from_arrays([qid[part], list_column(v[r[part]]), cell[part]], names=["qid", "v", "cell"])

    asking = queries.select("qid", "v")
    # Cell -2 counts the queries themselves.
    asked = {r["cell"]: r["n"] for r in asking.mapInArrow(counting, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    rows = asked.pop(-2, 0)
    compared = sum(m * facts[c]["n"] for c, m in asked.items() if c in facts)
    visits = asking.mapInArrow(visiting, "qid long, v array<double>, cell int")
    balls = BallCells(placed.drop("angle"), visits, compared, rows * n, sum(asked.values()) / max(1, rows))
    if balls.pays:
        balls.visits = cut(visits)
    return balls
