"""Approximate search: vectors laid out in cells, and product-quantised codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.vectors import as_double, dot
from ..session import cut, require_small
from .blocks import best_k, block_pairs, ints, list_column, matrix, tiled_best_k
from .similarity import PAIR, _pairs, top_k
from .ordering import top_per_key

#: Training looks at about so many rows per centroid or code; every row is placed afterwards.
TRAIN_PER_CELL = 256


def _drawn(items: DataFrame, want: int, n: int) -> DataFrame:
    """About ``want`` of the ``n`` rows, drawn by the hash of their id: the same rows
    however the table is partitioned."""
    if n <= want:
        return items
    return items.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 31)) < int(want / n * (1 << 31)))


def _share(spark: SparkSession, table: np.ndarray):
    """Broadcast centroids or codebooks, whose size is checked first."""
    require_small(len(table), table.nbytes // max(1, len(table)), S.BROADCAST_BYTES, "centroid table")
    return spark.sparkContext.broadcast(table)


def cell_count(n: int, quantised: bool = False) -> int:
    """⌊√n⌋ cells; at most n / 39 when quantised.

    More cells than a broadcast may hold are refused by the functions here; ``cell_tree`` has
    no such limit.
    """
    return max(1, min(math.isqrt(n), n // 39) if quantised else math.isqrt(n))


def train_cells(
    items: DataFrame, cells: int | None = None, seed: int = 42, iterations: int = 10, per_cell: int = TRAIN_PER_CELL
) -> np.ndarray:
    """Centroids of the cells, one row each, from (id, v). Training looks at about
    ``per_cell`` rows per cell; every row is placed in a cell afterwards."""
    n = items.count()
    k = cells or cell_count(n)
    # A zero vector has no direction to learn from; it is placed like any other.
    drawn = _drawn(items, k * per_cell, n).where(F.exists("v", lambda x: x != 0))
    train = drawn.select(array_to_vector(as_double(F.col("v"))).alias("features"))
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine", initMode="random").fit(train)
        centres = np.asarray(model.clusterCenters())
    else:  # one cell lies around the mean
        centres = train.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()[None, :]
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def assign(df: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Add ``cell``: one row per nearest cell, ``probes`` of them."""
    shared = _share(df.sparkSession, centres)
    probes = max(1, min(probes, len(centres)))
    ids = np.arange(len(centres))

    def run(batches):
        c = shared.value
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            r, cell = best_k(np.round(matrix(t["v"]) @ c.T, 9), ids, probes)
            out = t.take(pa.array(r)).append_column("cell", pa.array(cell, pa.int32()))
            yield from out.to_batches()

    kinds = ", ".join(f"{n} {k}" for n, k in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, cell int")


def search(
    queries: DataFrame, items: DataFrame, centres: np.ndarray, k: int = S.SEARCH_K,
    probes: int = S.PROBES, block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Top-k over the ``probes`` nearest cells; exact products inside them.

    ``items`` already has ``cell``; queries are placed here. An equi-join on the cell,
    with hot cells cut into blocks.
    """
    return top_k(assign(queries.select("qid", "v"), centres, probes), items, k, "cell", block_rows=block_rows)


# ── product quantisation ──────────────────────────────────────


def pq_shape(dim: int, n: int, m: int = S.PQ_SUBVECTORS, bits: int = S.PQ_BITS) -> tuple[int, int]:
    """The largest divisor of ``dim`` up to m, and the whole log2 of n between 4 and ``bits``."""
    parts = max(d for d in range(1, m + 1) if dim % d == 0)
    return parts, min(bits, max(4, n.bit_length() - 1))


def train_codebooks(residuals: DataFrame, m: int, bits: int, iterations: int = 6, per_code: int = TRAIN_PER_CELL) -> np.ndarray:
    """(m, 2^bits, dim/m) codebooks by k-means on every sub-vector at once.

    Each pass sends the codebooks out and brings back one sum and count per code, summed
    in the tasks first, so the driver sees a table of fixed size whatever the data.
    """
    codes = 2**bits
    train = cut(_drawn(residuals, codes * per_code, residuals.count()).select("v"))
    start = train.orderBy(F.xxhash64("v")).limit(codes).toArrow()
    book = matrix(start["v"])
    d = book.shape[1] // m
    if len(book) < codes:
        book = np.vstack([book, np.zeros((codes - len(book), book.shape[1]))])
    book = book.reshape(codes, m, d).transpose(1, 0, 2).copy()
    for _ in range(iterations):
        shared = _share(residuals.sparkSession, book)

        def run(batches):
            b = shared.value
            total, count = np.zeros_like(b), np.zeros(b.shape[:2])
            for x in batches:
                t = pa.Table.from_batches([x])
                v = matrix(t["v"])
                if len(v) == 0:
                    continue
                code = encode_rows(v, b)
                for s in range(b.shape[0]):
                    np.add.at(total[s], code[:, s], v[:, s * d : (s + 1) * d])
                    np.add.at(count[s], code[:, s], 1)
            s, c = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(count[s, c]), list_column(total[s, c])],
                names=["s", "c", "n", "total"],
            )

        part = train.mapInArrow(run, "s int, c int, n double, total array<double>")
        sums = part.groupBy("s", "c").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(d)]
        )
        for row in sums.collect():
            book[row["s"], row["c"]] = [row[f"t{i}"] / row["n"] for i in range(d)]
    return book


def encode_rows(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest code per sub-vector."""
    m, _, d = book.shape
    out = np.empty((len(v), m), dtype=np.int32)
    for s in range(m):
        part = v[:, s * d : (s + 1) * d]
        out[:, s] = np.argmin((book[s] ** 2).sum(1)[None, :] - 2.0 * part @ book[s].T, axis=1)
    return out


def residuals(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cell, v minus its cell's centroid)."""
    shared = _share(items.sparkSession, centres)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                cell = t["cell"].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [t["id"].combine_chunks(), t["cell"].combine_chunks(),
                     list_column(matrix(t["v"]) - shared.value[cell])],
                    names=["id", "cell", "v"],
                )

    return items.select("id", "cell", "v").mapInArrow(run, "id long, cell int, v array<double>")


def encode(residual: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, cell, codes): one small whole number per sub-vector."""
    shared = _share(residual.sparkSession, book)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                codes = encode_rows(matrix(t["v"]), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [t["id"].combine_chunks(), t["cell"].combine_chunks(), list_column(codes, pa.int32())],
                    names=["id", "cell", "codes"],
                )

    return residual.mapInArrow(run, f"id long, cell {dict(residual.dtypes)['cell']}, codes array<int>")


def pq_search(
    queries: DataFrame, coded: DataFrame, centres: np.ndarray, book: np.ndarray, k: int = S.SEARCH_K,
    probes: int = S.PROBES, items: DataFrame | None = None, refine: int = 4, block_rows: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Top-k by quantised scores; with ``items`` the best ``k * refine`` are re-ranked exactly.

    The score of an item is the query's product with the cell centroid plus one table
    look-up per sub-vector.
    """
    c_shared, b_shared = _share(queries.sparkSession, centres), _share(queries.sparkSession, book)
    wide = k * refine if items is not None else k
    placed = assign(queries.select("qid", "v"), centres, probes).withColumn("at", F.col("cell"))

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows == 0 or y.num_rows == 0:
            return _pairs([], [], [])
        q, codes, ids = matrix(x["v"]), matrix(y["codes"], np.int64), ints(y["id"])
        qid = ints(x["qid"])
        r, c, scores = best_coded(q, q @ c_shared.value[x["at"][0].as_py()], qid, codes, ids, b_shared.value, wide)
        return _pairs(qid[r], ids[c], scores)

    found = block_pairs(placed, coded, kernel, PAIR, "qid", "id", "cell", block_rows)
    best = top_per_key(found, ["qid"], [F.col("sim").desc(), F.col("id")], wide, "rank")
    return best if items is None else exact_order(best, queries, items, k)


def best_coded(q: np.ndarray, near: np.ndarray, qid: np.ndarray, codes: np.ndarray, ids: np.ndarray, book: np.ndarray, k: int):
    """Row and column numbers and quantised scores of the k best coded items per query.

    A score is ``near`` plus the query's product with the vector that the codes stand for: one
    matrix product, made tile by tile.
    """
    m, _, d = book.shape
    items = np.column_stack([*(book[s][codes[:, s]] for s in range(m)), np.ones(len(ids))])
    return tiled_best_k(np.column_stack([q[:, : m * d], near]), qid, items, ids, k)


def exact_order(best: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of found (qid, id), by their exact products."""
    exact = (
        best.select("qid", "id")
        .join(queries.select("qid", F.col("v").alias("_q")), "qid")
        .join(items.select("id", "v"), "id")
        .select("qid", "id", F.round(dot(F.col("_q"), F.col("v")), 9).alias("sim"))
    )
    return top_per_key(exact, ["qid"], [F.col("sim").desc(), F.col("id")], k, "rank")


# ── stored cells ──────────────────────────────────────────────


def write(items: DataFrame, centres: np.ndarray, path: str, trained_at: str) -> None:
    """Vectors by cell, the centroid table, and one row of facts about the training."""
    spark = items.sparkSession
    placed = items if "cell" in items.columns else assign(items, centres)
    # A cell's rows meet before they are written; a hot cell is split again by size.
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    facts = [(int(centres.shape[1]), int(len(centres)), int(items.count()), trained_at)]
    spark.createDataFrame(facts, "dim int, cells int, trained long, trained_at string").write.mode(
        "overwrite"
    ).json(f"{path}/meta")


def read(spark: SparkSession, path: str, dim: int) -> tuple[DataFrame, np.ndarray, dict]:
    """Stored vectors, centroids and training facts; another dimension is refused."""
    meta = spark.read.schema("dim int, cells int, trained long, trained_at string").json(f"{path}/meta").first()
    if meta["dim"] != dim:
        raise ValueError(f"stored vectors have {meta['dim']} entries, expected {dim}")
    require_small(meta["cells"], 8 * dim, S.BROADCAST_BYTES, "cell centroids")
    centres = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    return spark.read.parquet(f"{path}/vectors"), matrix(centres["v"]), meta.asDict()


def append(path: str, items: DataFrame, centres: np.ndarray) -> None:
    """Add vectors to the stored cells."""
    placed = assign(items, centres).hint("rebalance", "cell")
    placed.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def extend(path: str, items: DataFrame, dim: int, trained_at: str, ratio: float = S.REBUILD_RATIO) -> tuple[str, bool]:
    """Append (id, v), and train anew when the rows since training exceed ``ratio`` of those
    trained on.

    Returns the folder to read from now on and whether it was trained anew. The new layout
    goes to a folder of its own, so readers of the old one and a failed run lose nothing.
    """
    spark = items.sparkSession
    _, centres, meta = read(spark, path, dim)
    append(path, items.select("id", "v"), centres)
    stored = spark.read.parquet(f"{path}/vectors").select("id", "v")
    if stored.count() - meta["trained"] <= meta["trained"] * ratio:
        return path, False
    fresh = f"{path}_{trained_at}"
    write(stored, train_cells(stored), fresh, trained_at)
    return fresh, True


def drift(items: DataFrame, added_at: str, trained_at, ratio: float = S.REBUILD_RATIO) -> DataFrame:
    """Rows since training against trained rows, per cell and (NULL cell) in total."""
    late = F.col(added_at) > F.lit(trained_at)
    return (
        items.rollup("cell")
        .agg(F.count_if(~late).alias("trained"), F.count_if(late).alias("added"))
        .withColumn("retrain", (F.col("trained") > 0) & (F.col("added") > F.col("trained") * ratio))
    )


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti")


def remove_stored(path: str, ids: DataFrame) -> int:
    """Rewrite only the cells that hold one of ``ids``; returns how many those are.

    The new rows go to a side folder first, then replace the touched partitions.
    """
    spark = ids.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    touched = stored.join(ids.select("id"), "id", "left_semi").select("cell").distinct()
    affected = stored.join(touched, "cell", "left_semi")
    kept = remove(affected, ids)
    emptied = touched.join(kept.select("cell").distinct(), "cell", "left_anti").count()
    cells = touched.count()
    kept.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/_pending")
    if emptied:
        # Cells left without rows need the whole layout written again.
        remove(stored, ids).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors_next")
        spark.read.parquet(f"{path}/vectors_next").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    else:
        spark.read.parquet(f"{path}/_pending").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("cell").parquet(f"{path}/vectors")
    return cells
