"""Listings: main and detail images, titles, prices, checks, the final feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .ordering import top_per_key
from .state import join_marks


def draw(key: Column, seed: int, n: int) -> Column:
    """A repeatable choice from 0..n-1 per key, in place of a random one."""
    return F.pmod(key.cast("bigint") * 7919 + F.lit(seed * 104729), F.lit(n)).cast("int")


def pick(pool: Sequence[str], key: Column, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in pool]), draw(key, seed, len(pool)) + 1)


def compose_title(key: Column, category: Column) -> Column:
    """Prefix, style, category and suffix in one string."""
    return F.concat(
        pick(S.TITLE_PREFIXES, key, 1), pick(S.TITLE_STYLES, key, 2), category, pick(S.TITLE_SUFFIXES, key, 3)
    )


def price(key: Column, lo: float, hi: float | None = None) -> Column:
    """Fixed price, or a repeatable one between ``lo`` and ``hi`` with two decimals."""
    if hi is None:
        return F.lit(float(lo))
    return F.round(F.lit(float(lo)) + (draw(key, 5, 10007) / 10006.0) * (hi - lo), 2)


def main_detail(images: Column, main: int = S.MAIN_IMAGES, detail: int = S.DETAIL_IMAGES):
    """First ``main`` paths of a sorted array, and up to ``detail`` after them."""
    return F.slice(images, 1, main), F.slice(images, main + 1, detail)


def listing_images(
    files: DataFrame, folder: str = "folder", path: str = "path",
    main: int = S.MAIN_IMAGES, detail: int = S.DETAIL_IMAGES,
) -> DataFrame:
    """Main and detail images per folder, from the first ``main + detail`` paths only."""
    head = top_per_key(files.select(folder, path), [folder], [F.col(path)], main + detail)
    sorted_paths = head.groupBy(folder).agg(F.array_sort(F.collect_list(path)).alias("_p"))
    m, d = main_detail(F.col("_p"), main, detail)
    return sorted_paths.select(folder, m.alias("main_images"), d.alias("detail_images"))


def preview(files: DataFrame, folder: str, path: str, keep: int = S.PREVIEW_IMAGES) -> DataFrame:
    """First images of every product and how many more there are."""
    counts = files.groupBy(folder).agg(F.count(F.lit(1)).alias("_n"))
    head = top_per_key(files.select(folder, path), [folder], [F.col(path)], keep, "position")
    return head.join(counts, folder).withColumn(
        "more", F.greatest(F.col("_n") - keep, F.lit(0))
    ).drop("_n")


def select_listings(listings: DataFrame, marks: DataFrame, order: str, which: str, n: int) -> DataFrame:
    """The listings that get ticked: first ``n`` of all or of those not uploaded.

    Ticking the uploaded ones has no upper bound, so ``n`` does not apply there.
    """
    joined = join_marks(listings, marks)
    if which == "uploaded":
        return joined.where("uploaded")
    kept = joined if which == "all" else joined.where("NOT uploaded")
    return kept.orderBy(order).limit(n)


def check_listing(title: Column, price_text: Column, selected: Column) -> Column:
    """Warnings of one listing row; rows not selected have none."""
    value = F.trim(price_text).try_cast("double")
    found = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("empty title")),
            F.when(value.isNull(), F.lit("invalid price")).when(value <= 0, F.lit("price <= 0")),
        )
    )
    return F.when(selected, found).otherwise(F.array().cast("array<string>"))


def feed(listings: DataFrame, marks: DataFrame) -> DataFrame:
    """Final rows: title or folder name, price, image counts (none: 0) and upload state."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("folder"))
    return join_marks(listings, marks).select(
        "row",
        "folder",
        title.alias("title"),
        F.format_string("%.2f", "price").alias("price"),
        F.coalesce(F.size("main_images"), F.lit(0)).alias("n_main"),
        F.coalesce(F.size("detail_images"), F.lit(0)).alias("n_detail"),
        F.when(F.col("uploaded"), "uploaded").otherwise("waiting").alias("state"),
    )
