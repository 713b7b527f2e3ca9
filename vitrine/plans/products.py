"""New product folders against the registry: vectors, matches, decisions, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, pixels, registry, summaries


def scan(folders: DataFrame, image_vectors: DataFrame, products: DataFrame, dim: int | None = None) -> DataFrame:
    """Scan (row, folder) in row order: status, best match, vector or error per folder.

    ``image_vectors`` is (folder, v); ``products`` the registry with its vectors. Folders
    already registered are left out. ``dim`` is the length of the vectors, by default the
    most frequent one of the images. Registered vectors of another length are skipped; an
    image with another length, or none, is not usable.
    """
    fresh = registry.new_folders(folders, products)
    if dim is None:
        sizes = image_vectors.where("v is not null").groupBy(F.size("v").alias("d")).count()
        most = sizes.orderBy(F.desc("count"), "d").first()
        dim = most["d"] if most else 1
    whole = F.coalesce(F.size("v") == dim, F.lit(False))
    blank = F.array_repeat(F.lit(0.0), dim).cast(image_vectors.schema["v"].dataType)
    image_vectors = image_vectors.withColumn("v", F.when(whole, F.col("v")).otherwise(blank))
    vectors = dedup.product_vectors(image_vectors.join(fresh.select("folder"), "folder", "left_semi"), "folder")
    usable = fresh.join(vectors.where("n_images > 0"), "folder").select(F.col("row").alias("qid"), F.col("vector").alias("v"))
    known = registry.vectors(products, dim).select("id", F.col("embedding").alias("v"))
    decided = dedup.batch_scan(usable, known).withColumnRenamed("qid", "row")
    wide = vectors.join(fresh.select("row", "folder"), "folder")
    return dedup.scan_folders(fresh, wide, decided, "row")


def matched(scanned: DataFrame, products: DataFrame) -> DataFrame:
    """(row, match_id, name, store, folder): the product that each scanned row matches best.

    It is a registered product, or a new item of the same scan, whose id is negative.
    """
    own = lambda c: (F.col(c) if c in scanned.columns else F.lit(None)).cast("string").alias(c)
    batch = scanned.select((F.lit(-1) - F.col("row")).alias("id"), own("name"), own("store"), "folder")
    wanted = scanned.where(F.col("best_id").isNotNull()).select("row", F.col("best_id").alias("match_id"))
    return registry.resolve_matches(wanted, batch, products)


def image_vectors(images: DataFrame, store: DataFrame, now: Column, make=None) -> tuple[DataFrame, DataFrame]:
    """(folder, v) of image pixels through the feature store, and the store rows to add."""
    found, rows = pixels.feature_pipeline(images, store, now, make=make)
    return images.select("key", "folder").join(found, "key").select("folder", F.col("feature").alias("v")), rows


def register(scanned: DataFrame, products: DataFrame, handled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New items added to the registry, and the conflicts."""
    return registry.append(summaries.registrable(scanned, handled), products, "row")
