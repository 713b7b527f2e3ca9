"""Matrix blocks: pair up two vector tables block by block with NumPy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S

SIM_DECIMALS = 9
#: Block products are dealt over at most so many tasks per core or shuffle partition.
TASKS_PER_CORE = 8
#: Blocks are not cut below so many rows just to have more of them.
FEW_ROWS = 1024
#: Queries and items whose products a task holds at once.
TILE_QUERIES, TILE_ITEMS = 512, 1024
#: From so many candidates a query and tile on, its products are made in double precision at once.
MANY = 64
#: A packed block has so many bytes a row at most.
ROW_BYTES = 32 << 20


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """List column as an (n, d) array, without per-row objects; null and unequal lists are refused."""
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype=dtype)
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if column.null_count or lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} to {lengths['max']} entries and {column.null_count} nulls in one block")
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(n, -1).astype(dtype, copy=False)


def ints(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False)


def list_column(rows: np.ndarray, kind=pa.float64()) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(rows.ravel(), type=kind)
    )


def similarities(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, rounded so that equal vectors tie and thresholds are inclusive."""
    return np.round(q @ v.T, SIM_DECIMALS)


def best_k(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best entries per row; ties go to the lower id."""
    n = sims.shape[1]
    order = np.argsort(ids, kind="stable")
    s = sims[:, order]
    if n <= k:
        top = np.argsort(-s, axis=1, kind="stable")
    else:
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(s, top, 1).min(axis=1, keepdims=True)
        tied = (s >= kth).sum(axis=1) > k
        if tied.any():
            top[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(s.shape[0]), top.shape[1])
    cols = order[top.ravel()]
    keep = sims[rows, cols] > -np.inf
    return rows[keep], cols[keep]


def tile_edges(n: int, width: int, first: int | None = None) -> list[tuple[int, int]]:
    """Consecutive ranges of at most ``width`` that cover n rows; the first one of at most ``first``."""
    out, low = [], 0
    while low < n:
        high = min(n, low + (first if first and low == 0 else width))
        out.append((low, high))
        low = high
    return out


def screen(q: np.ndarray, v: np.ndarray, turn: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides in single precision, rows in the given orders, and how far a product of them may be off, per query.

    Lengths that single precision cannot hold keep the vectors as they are.
    """
    lengths, longest = np.sqrt(np.einsum("ij,ij->i", q, q))[turn], np.sqrt(np.einsum("ij,ij->i", v, v).max())
    if not (np.isfinite(longest) and np.isfinite(lengths).all() and longest < 1e15 and lengths.max() < 1e15):
        return q[turn], v[order], np.zeros(len(q))
    off = (q.shape[1] + 8) * 1.2e-7 * lengths * longest + 1e-30
    return q.astype(np.float32)[turn], v.astype(np.float32)[order], off


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix with few hits."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class _Tile:
    """Products of two parts, in one piece of memory that is used again."""

    def __init__(self, kind: np.dtype):
        self.space = np.empty(TILE_QUERIES * TILE_ITEMS, kind)

    def __call__(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.matmul(q, v.T, out=self.space[: len(q) * len(v)].reshape(len(q), len(v)))


def products(q: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rounded inner products of the rows ``r`` of q and ``c`` of v."""
    return np.round(np.einsum("ij,ij->i", q[r], v[c]), SIM_DECIMALS)


class BestK:
    """The k best items of every query of a block, ties to the lower id; items come in blocks, in any order.

    Products are made tile by tile. Single precision rules out what is surely below the k-th best
    found so far, and what is left is multiplied again in double precision, from the rows as they are:
    only the single ones are put in order. ``earlier_only`` leaves out items whose id is not below the query's.
    """

    def __init__(self, q: np.ndarray, qid: np.ndarray, k: int, earlier_only: bool = False):
        self.q, self.qids, self.k, self.earlier_only = q, qid, k, earlier_only
        self.turn = np.argsort(qid, kind="stable")
        self.qid = qid[self.turn]
        self.edges = tile_edges(len(q), TILE_QUERIES)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for _ in self.edges]
        # The k-th best of each query, and its id.
        self.floor, self.last = np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)

    def meet(self, v: np.ndarray, ids: np.ndarray) -> None:
        if not len(self.q) or not len(v) or (self.earlier_only and ids.min() >= self.qid[-1]):
            return
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        qs, vs, off = screen(self.q, v, self.turn, order)
        tile = _Tile(qs.dtype)
        for n, (a, b) in enumerate(self.edges):
            floor, waiting = self.floor[a:b], []
            first = min(TILE_ITEMS, max(512, 4 * self.k)) if np.isneginf(floor).any() else None
            for low, high in tile_edges(len(v), TILE_ITEMS, first):
                if self.earlier_only and ids[low] >= self.qid[b - 1]:
                    break
                r, c, s = self._candidates(tile, qs, vs, off[a:b], v, ids, order, (a, b), (low, high))
                if len(r):
                    waiting.append((r, ids[low + c], s))
                    if np.isneginf(floor).any() or sum(len(x[0]) for x in waiting) > self.k * (b - a):
                        self._settle(n, waiting)
                        waiting = []
            if waiting:
                self._settle(n, waiting)

    def _candidates(self, tile, qs, vs, off, v, ids, order, rows, columns):
        """Row, column and similarity of what a tile may add to the best."""
        (a, b), (low, high) = rows, columns
        floor, k = self.floor[a:b], self.k
        later = ids[None, low:high] >= self.qid[a:b, None] if self.earlier_only and ids[high - 1] >= self.qid[a] else None
        s = tile(qs[a:b], vs[low:high])
        if later is not None:
            s[later] = -np.inf
        bar = floor
        if high - low > k and np.isneginf(floor).any():
            # What reaches the tile's own k-th value, give or take the error, holds its best k.
            bar = np.maximum(floor, np.partition(s, high - low - k, axis=1)[:, high - low - k].astype(np.float64))
        r, c = _where(s >= (bar - 2 * off - 1e-9).astype(s.dtype)[:, None])
        if len(r) > MANY * (b - a):
            # Many ties: of those with the k-th best, only lower ids count.
            s, last = similarities(self.q[self.turn[a:b]], v[order[low:high]]), self.last[a:b]
            if later is not None:
                s[later] = -np.inf
            better = s > floor[:, None]
            if ids[low] < last.max():
                better |= (s == np.where(np.isneginf(floor), np.nan, floor)[:, None]) & (ids[None, low:high] < last[:, None])
            r, c = _where(better)
            if len(r) > MANY * (b - a):
                r, c = best_k(s, ids[low:high], k)
            return r, c, s[r, c]
        if later is not None:
            kept = ~later[r, c]
            r, c = r[kept], c[kept]
        return r, c, products(self.q, v, self.turn[a + r], order[low + c])

    def _settle(self, n: int, waiting: list[tuple[np.ndarray, ...]]) -> None:
        a, b = self.edges[n]
        rows = tuple(np.concatenate(x) for x in zip(self.found[n], *waiting))
        self.found[n], self.floor[a:b], self.last[a:b] = _first_k(rows, b - a, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of queries, ids of items, and similarities."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        r, i, s = (np.concatenate(x) for x in zip(*[(x[0] + a, *x[1:]) for (a, _), x in zip(self.edges, self.found)]))
        return self.turn[r], i, s


def tiled_best_k(q: np.ndarray, qid: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, earlier_only: bool = False):
    """Row and column numbers and similarities of the k best items per query, ties to the lower id."""
    order = np.argsort(ids, kind="stable")
    # The place of an item in the order of ids stands for its id.
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    best = BestK(q, np.searchsorted(ids[order], qid), k, earlier_only)
    best.meet(v, place)
    r, i, s = best.rows()
    return r, order[i], s


def _first_k(rows: tuple[np.ndarray, ...], n: int, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The k best of (row, id, similarity) per row, and the k-th similarity and id of each, where there are k."""
    r, i, s = rows
    by = np.lexsort((i, -s, r))
    r, i, s = r[by], i[by], s[by]
    starts = np.searchsorted(r, np.arange(n))
    rank = np.arange(len(r)) - starts[r]
    kept = rank < k
    floor, last_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
    last = rank == k - 1
    floor[r[last]], last_id[r[last]] = s[last], i[last]
    return (r[kept], i[kept], s[kept]), floor, last_id


class AnyEarlier:
    """Whether each query of a block has an item of a lower id with a similarity of ``floor`` or more."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, floor: float):
        self.q, self.qids, self.floor = q, qid, floor
        self.turn = np.argsort(qid, kind="stable")
        self.qid, self.hit = qid[self.turn], np.zeros(len(q), bool)

    def meet(self, v: np.ndarray, ids: np.ndarray) -> None:
        if not len(self.q) or not len(v) or ids.min() >= self.qid[-1]:
            return
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        q, qid, turn, hit, floor = self.q, self.qid, self.turn, self.hit, self.floor
        qs, vs, off = screen(q, v, turn, order)
        tile = _Tile(qs.dtype)
        for a, b in tile_edges(len(q), TILE_QUERIES):
            bar = floor - 2 * off[a:b] - 1e-9
            for low, high in tile_edges(len(v), TILE_ITEMS):
                if ids[low] >= qid[b - 1]:
                    break
                s = tile(qs[a:b], vs[low:high])
                # Rows that hold a match already need no other.
                r, c = _where(s >= np.where(hit[a:b], np.inf, bar).astype(s.dtype)[:, None])
                if len(r) > MANY * (b - a):
                    near = (similarities(q[turn[a:b]], v[order[low:high]]) >= floor) & (ids[None, low:high] < qid[a:b, None])
                    hit[a:b] |= near.any(axis=1)
                    continue
                earlier = ids[low + c] < qid[a + r]
                r, c = r[earlier], c[earlier]
                hit[a + r[products(q, v, turn[a + r], order[low + c]) >= floor]] = True

    def rows(self) -> np.ndarray:
        out = np.empty(len(self.q), bool)
        out[self.turn] = self.hit
        return out


def tiled_any(q: np.ndarray, qid: np.ndarray, v: np.ndarray, ids: np.ndarray, floor: float) -> np.ndarray:
    """Whether each query has an item of a lower id with a similarity of ``floor`` or more."""
    found = AnyEarlier(q, qid, floor)
    found.meet(v, ids)
    return found.rows()


def _packed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """(number, piece, rows): (key, v) cut by hash into ``blocks`` blocks, a partition and a row of Arrow bytes each.

    Rows of bytes have a limit of their own, ``ROW_BYTES``: a block of long vectors is several pieces.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        number, t = t["_block"].slice(0, 1).combine_chunks(), t.drop_columns(["_block"])
        rows = max(1, -(-t.num_rows // -(-t.nbytes // ROW_BYTES)))
        for piece, start in enumerate(range(0, t.num_rows, rows)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t.slice(start, rows))
            yield pa.RecordBatch.from_arrays(
                [number, pa.array([piece], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["number", "piece", "rows"])

    cut = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    return df.select(key, "v", cut.alias("_block")).repartitionById(blocks, F.col("_block")).mapInArrow(pack, "number int, piece int, rows binary")


def every_block(
    queries: DataFrame, items: DataFrame, begin: Callable[[np.ndarray, np.ndarray], object], end: Callable[[object], pa.Table],
    schema: str, block_rows: int = S.VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """Every block of ``queries`` (qid, v) meets every block of ``items`` (id, v).

    ``begin`` makes what a task holds of a block of queries, its ``meet`` takes the blocks of items one
    by one, and what ``end`` makes of it is handed on. A task has one block of queries and a share of
    the items, in as many shares as the cores ask for. Blocks are written once for all they meet, so what
    is written grows with the two sides, not with the pairs of their blocks.
    """
    spark = queries.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nq, ni = _cuts(queries.count(), items.count(), block_rows, 4 * cores)
    shares = min(ni, -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // nq))
    a = _packed(queries, "qid", nq).select("number", "piece", F.col("rows").alias("_asking"))
    b = _packed(items, "id", ni).repartitionById(shares, F.pmod("number", F.lit(shares))).select(F.col("rows").alias("_asked"))

    def read(cell: pa.BinaryScalar, key: str) -> tuple[np.ndarray, np.ndarray]:
        t = pa.ipc.open_stream(cell.as_buffer()).read_all()
        return matrix(t["v"]), ints(t[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch["number"][i].as_py(), batch["piece"][i].as_py()
                if name not in held:
                    held[name] = begin(*read(batch["_asking"][i], "qid"))
                held[name].meet(*read(batch["_asked"][i], "id"))
        for found in held.values():
            yield from end(found).to_batches()

    # The items pass by one at a time while the queries of the task stay.
    return b.hint("shuffle_replicate_nl").crossJoin(a).mapInArrow(run, schema)


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    left_id: str,
    right_id: str,
    cell: str,
    block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel`` on every pair of blocks of the two sides that lie in one cell.

    Blocks are cut by hash so that none exceeds ``block_rows`` rows by much, however many rows a cell
    holds: a hot cell simply has more blocks. What crosses the network is each side times
    the number of blocks it meets, plus the small per-block results.
    """
    count = lambda df, name: df.groupBy(F.col(cell).alias("_cell")).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name)
    )
    sizes = count(left, "_nl").join(count(right, "_nr"), "_cell")
    a = left.withColumnRenamed(cell, "_cell").join(sizes, "_cell")
    b = right.withColumnRenamed(cell, "_cell").join(sizes, "_cell")
    cut = lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.withColumn("_lb", cut(left_id, "_nl")).withColumn("_rb", every("_nr")).drop("_nl", "_nr")
    b = b.withColumn("_rb", cut(right_id, "_nr")).withColumn("_lb", every("_nl")).drop("_nl", "_nr")
    keys = ["_cell", "_lb", "_rb"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return kernel(x, y)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def _cuts(left: int, right: int, block_rows: int, want: int) -> tuple[int, int]:
    """Blocks of the two sides: none above ``block_rows``, and ``want`` pairs of them unless blocks get small."""
    nl, nr = max(1, -(-left // block_rows)), max(1, -(-right // block_rows))
    while nl * nr < want:
        # The side with the bigger blocks is cut further.
        more_left = left / nl >= right / nr
        if (left / (nl + 1) if more_left else right / (nr + 1)) < FEW_ROWS:
            break
        nl, nr = (nl + 1, nr) if more_left else (nl, nr + 1)
    return nl, nr
