"""Product duplicates: product vectors, decisions, and the ordered batch scan."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import vectors as V
from ..session import cut
from . import radius
from .leaders import greedy_leaders
from .ordering import top_per_key
from .similarity import top_k, with_match

MATCHES = "array<struct<id:bigint,sim:double>>"


def mean_vector(images: DataFrame, key: str, v: str = "v") -> DataFrame:
    """Mean of the vectors of every key, added up in the map tasks first."""
    return images.groupBy(key).agg(
        vector_to_array(Summarizer.mean(array_to_vector(V.as_double(F.col(v))))).alias("mean"),
        F.count(F.lit(1)).alias("n_images"),
    )


def product_vectors(images: DataFrame, key: str, v: str = "v") -> DataFrame:
    """Unit mean vector per product over its usable (non-zero) image vectors.

    A product without a usable image keeps a row with a zero vector and ``n_images`` 0, so
    that the scan can report it.
    """
    ok = V.norm(F.col(v)) > S.ZERO_NORM
    counted = F.when(F.col("_ok"), V.as_double(F.col(v))).otherwise(F.transform(v, lambda _: F.lit(0.0)))
    # The unit mean is the unit sum: one pass, in which unusable images add nothing.
    sums = images.withColumn("_ok", ok).groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector(counted))).alias("_sum"),
        F.count_if("_ok").alias("n_images"),
        F.count(F.lit(1)).alias("n_all"),
    )
    return sums.select(key, V.l2_normalize(F.col("_sum")).alias("vector"), "n_images", "n_all")


def first_n_vectors(images: DataFrame, key: str, order: str, n: int = S.CLASSIFY_IMAGES, v: str = "v") -> DataFrame:
    """Unit mean of the first ``n`` images; zero vectors count, as in naming."""
    head = top_per_key(images.select(key, order, v), [key], [F.col(order)], n)
    return mean_vector(head, key, v).select(key, V.l2_normalize(F.col("mean")).alias("vector"), "n_images")


def decide(
    queries: DataFrame, matches: DataFrame, key: str = "qid",
    duplicate: float = S.DUPLICATE_THRESHOLD, review: float = S.REVIEW_THRESHOLD,
) -> DataFrame:
    """Status and matches of every query from its ranked matches (key, id, sim, rank).

    Both limits are inclusive. Duplicates and reviews keep the matches from ``review``
    up, new items keep all of them; a query without matches is new.
    """
    lists = matches.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "sim"))).alias("_m")
    )
    ranked = F.transform("_m", lambda m: F.struct(m["id"].alias("id"), m["sim"].alias("sim")))
    best = F.get(F.col("matches"), 0)["sim"]
    status = (
        F.when(best >= duplicate, S.DUPLICATE).when(best >= review, S.REVIEW).otherwise(S.NEW)
    )
    return (
        queries.join(lists, key, "left")
        .withColumn("matches", F.coalesce(ranked, F.array().cast(MATCHES)))
        .drop("_m")
        .withColumn("status", status)
        .withColumn("best_id", F.get(F.col("matches"), 0)["id"])
        .withColumn("best_sim", best)
        .withColumn(
            "matches",
            F.when(F.col("status") == S.NEW, F.col("matches")).otherwise(
                F.filter("matches", lambda m: m["sim"] >= review)
            ),
        )
    )


def scan_folders(products: DataFrame, product_vecs: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """One row per product; those without images, or without a usable one, are errors.

    Error rows carry the status new and no vector, and are counted as errors only.
    """
    return (
        products.join(product_vecs.select(key, "vector", "n_images", "n_all"), key, "left")
        .join(decided.select(key, F.col("status").alias("_s"), "best_id", "best_sim"), key, "left")
        .withColumn(
            "error",
            F.when(F.col("n_all").isNull(), F.lit("no images")).when(
                F.col("n_images") == 0, F.lit("no usable image")
            ),
        )
        .withColumn("status", F.coalesce(F.when(F.col("error").isNull(), F.col("_s")), F.lit(S.NEW)))
        .withColumn("embedding", F.when(F.col("error").isNull(), F.col("vector")))
        .withColumn("best_id", F.when(F.col("error").isNull(), F.col("best_id")))
        .withColumn("best_sim", F.when(F.col("error").isNull(), F.col("best_sim")))
        .drop("_s", "vector", "n_images")
    )


def _matcher(vectors: DataFrame, floor: float, block_rows: int):
    """A function of two parts of (qid, v): ids of the first with an earlier match in the second.

    More vectors than a block are laid out in cells with radii once, and parts then meet only in
    cells that may hold a match; where that would leave out too little, all blocks meet.
    """
    as_items = lambda df: df.select(F.col("qid").alias("id"), "v")
    balls = None
    if vectors.count() > block_rows:
        vectors = cut(vectors)
        balls = radius.build(vectors, as_items(vectors), floor)
    if balls is None or not balls.pays:
        return lambda rest, others: with_match(rest.select("qid", "v"), as_items(others), floor, block_rows)

    def matched(rest: DataFrame, others: DataFrame) -> DataFrame:
        asking = balls.visits.join(rest.select("qid"), "qid", "left_semi")
        asked = balls.items.join(others.select(F.col("qid").alias("id")), "id", "left_semi")
        return with_match(asking, asked, floor, block_rows, "cell")

    return matched


def batch_scan(
    candidates: DataFrame, registry: DataFrame, k: int = S.SEARCH_K,
    duplicate: float = S.DUPLICATE_THRESHOLD, review: float = S.REVIEW_THRESHOLD,
    block_rows: int = S.VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """Scan (qid, v) in id order; every new item is visible to the later ones.

    ``registry`` is (id, v) with ids that are not negative. Matches among the batch are
    reported with the id -1 - qid. An item is new when neither the registry nor an earlier
    new item reaches ``review``; which items those are is a greedy-leader question over
    distinct vectors, since a copy can never be new. The final matches then come from the
    registry and the earlier new items.
    """
    candidates = cut(candidates)
    known = cut(top_k(candidates, registry, k, block_rows=block_rows))
    taken = known.where((F.col("rank") == 1) & (F.col("sim") >= review)).select("qid")
    open_ = candidates.join(taken, "qid", "left_anti").select("qid", "v")
    distinct = open_.groupBy("v").agg(F.min("qid").alias("qid")).select("qid", "v")
    as_items = lambda df: df.select(F.col("qid").alias("id"), "v")
    matched = _matcher(distinct, review, block_rows)
    new_items = cut(greedy_leaders(distinct, "qid", lambda rest: matched(rest, rest), matched))
    batch = top_k(candidates.select("qid", "v"), as_items(new_items), k, earlier_only=True, block_rows=block_rows)
    both = known.drop("rank").unionByName(
        batch.select("qid", (F.lit(-1) - F.col("id")).alias("id"), "sim")
    )
    # Registry entries come before batch entries of the same similarity.
    ranked = top_per_key(
        both, ["qid"], [F.col("sim").desc(), (F.col("id") < 0), F.abs("id")], k, "rank"
    )
    return decide(candidates.drop("v"), ranked, "qid", duplicate, review)
