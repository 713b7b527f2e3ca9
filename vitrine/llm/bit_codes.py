"""Nearest vectors through randomly rotated one-bit codes.

Vectors are centred on the mean of all, scaled to length one, turned by a random rotation
into ``bits`` coordinates, and kept as the signs of these: one packed bit each, with the
length and one correction factor. For a turned query, quantised to a few bit planes, the
inner product with a code is a handful of popcounts; with the correction it estimates the
true one, and the random rotation bounds the error. Only vectors that the bound cannot rule
out are ranked by their exact distance. Queries and vectors meet in blocks, and each pair of
blocks returns k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BITS_PER_DIM = 2
QUERY_BITS = 6
#: Deviations of the estimate that the bound allows for.
BOUND = 4.0
QUERY_BLOCK = 4_096
VECTOR_BLOCK = 65_536
#: A table that fills fewer blocks than the cluster has partitions is cut finer, down to this.
LEAST_BLOCK = 4_096


def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """Orthonormal rows: ``dim`` coordinates into ``bits`` >= dim."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and ``v``: no null key, no null or non-finite component, not zero.

    Of rows that repeat a key the one with the smallest vector, component by component, counts.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), v.alias("v")).where(fine).groupBy(key).agg(F.min("v").alias("v"))


def build_all(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", bits_per_dim: int = BITS_PER_DIM) -> list[tuple[DataFrame, np.ndarray, int]]:
    """An index per length of vectors, the shortest first; vectors of different lengths have no distance."""
    fine = cut(usable(vectors, key, vector))
    sizes = sorted(r["d"] for r in fine.select(F.size("v").alias("d")).distinct().collect())
    return [_index(fine.where(F.size("v") == d), d, key, bits_per_dim) for d in sizes or [1]]


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", bits_per_dim: int = BITS_PER_DIM) -> tuple[DataFrame, np.ndarray, int]:
    """The index of the vectors of the most frequent length, of equal ones the shortest."""
    return max(build_all(vectors, key, vector, bits_per_dim), key=lambda index: index[0].count())


def _index(fine: DataFrame, dim: int, key: str, bits_per_dim: int) -> tuple[DataFrame, np.ndarray, int]:
    """The written index (key, v, code, length, correction), the centre, and the number of bits.

    Every vector is indexed. The centre is the mean over all of them.
    """
    mean = fine.agg(F.array(*(F.coalesce(F.avg(F.col("v")[i]), F.lit(0.0)) for i in range(dim))).alias("c")).first()
    centre = np.array(mean["c"])
    bits = -(-dim * bits_per_dim // 64) * 64
    turn = rotation(dim, bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["v"]) - centre
            length = np.linalg.norm(x, axis=1)
            u = (x / np.where(length > 0, length, 1)[:, None]) @ turn
            signs = u > 0
            dots = np.abs(u).sum(axis=1) / np.sqrt(bits)
            yield pd.DataFrame({key: b[key], "v": b["v"], "code": [c.tobytes() for c in np.packbits(signs, axis=1)], "length": length, "fit": dots})

    index = fine.mapInPandas(run, f"{key} long, v array<double>, code binary, length double, fit double")
    return cut(index), centre, bits


def search(index: DataFrame, queries: DataFrame, centre: np.ndarray, bits: int, key: str = "vec_id", k: int = 10, bound: float = BOUND,
           query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, the key and score (Euclidean distance) of each query's k nearest rows.

    ``queries`` are rows of the index. A query's own id is no candidate; equal distances go
    to the smaller id.
    """
    turn = rotation(len(centre), bits)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, asked = index.count(), queries.count()
    nq = max(1, -(-asked // query_block))
    nv = max(1, -(-rows // vector_block), min(parts // nq, -(-rows // min(LEAST_BLOCK, vector_block))))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(key).alias("q"), F.col("v").alias("qv"), place(nq).alias("_q"), every(nv).alias("_v"))
    right = index.withColumn("_v", place(nv)).withColumn("_q", every(nq))

    def nearest(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", key, "score"]
        if qs.empty or vs.empty:
            return pd.DataFrame({c: [] for c in cols}).astype({"query_id": "int64", key: "int64"})
        vs = vs.sort_values(key)
        ids, v = vs[key].to_numpy(), np.stack(vs["v"])
        codes = np.frombuffer(b"".join(vs["code"]), np.uint8).reshape(len(vs), -1).copy().view(np.uint64)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        length, fit = vs["length"].to_numpy(), np.maximum(vs["fit"].to_numpy(), 1e-9)
        spread = bound * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(bits - 1)
        out = []
        for qid, qv in zip(qs["q"], qs["qv"], strict=True):
            d = qv - centre
            far = np.linalg.norm(d)
            u = d / far @ turn if far > 0 else np.zeros(bits)
            low, step = u.min(), max((u.max() - u.min()) / (2**QUERY_BITS - 1), 1e-12)
            grid = np.rint((u - low) / step).astype(np.uint8)
            planes = [np.packbits((grid >> j) & 1).view(np.uint64) for j in range(QUERY_BITS)]
            hits = sum((np.bitwise_count(codes & p).sum(axis=1, dtype=np.int64) << j) for j, p in enumerate(planes))
            # sum of sign * u = 2 * (step * hits + low * ones) - sum(u), with u rounded to the grid
            raw = 2 * (step * hits + low * ones) - (step * grid.astype(np.int64) + low).sum()
            cosine = raw / np.sqrt(bits) / fit
            slack = spread + step / 2 / fit  # the rotation's error, and that of rounding the query
            base = length**2 + far**2
            near, most = base - 2 * length * far * (cosine + slack), base - 2 * length * far * (cosine - slack)
            other = ids != qid
            if other.sum() > k:
                cutoff = np.partition(most[other], k - 1)[k - 1]
                other &= near <= cutoff + 1e-9 * (1 + abs(cutoff))
            pick = np.flatnonzero(other)
            exact = np.sqrt(((v[pick] - qv) ** 2).sum(axis=1))
            best = np.argsort(exact, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": qid, key: ids[pick[best]], "score": exact[best]}))
        return pd.concat(out)[cols]

    found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(nearest, f"query_id long, {key} long, score double")
    # k rows per query and vector block; the limit on the rank cuts them before they are shuffled.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
