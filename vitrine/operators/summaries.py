"""Counters over scan, split, processing and upload results; filters over the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S


def _no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def dedup_summary(items: DataFrame) -> DataFrame:
    """Counts of duplicate, review, new without error, and error rows."""
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == S.DUPLICATE).alias("duplicate"),
        F.count_if(F.col("status") == S.REVIEW).alias("review"),
        F.count_if((F.col("status") == S.NEW) & _no_error()).alias("new"),
        F.count_if(~_no_error()).alias("error"),
    )


def split_summary(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("folders"),
        F.count_if(F.col("group_count") > 1).alias("need_split"),
    )


def process_summary(images: DataFrame, folder: str = "folder") -> DataFrame:
    """Processed, skipped and failed images per folder and (NULL folder) in total."""
    return images.rollup(folder).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def upload_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("success")).alias("ok"), F.count_if(~F.col("success")).alias("failed")
    )


def filter_status(items: DataFrame, which: str) -> DataFrame:
    """all, duplicate, review, new (without error) or error."""
    if which == "all":
        return items
    if which == "error":
        return items.where(~_no_error())
    if which == S.NEW:
        return items.where((F.col("status") == S.NEW) & _no_error())
    return items.where(F.col("status") == which)


def filter_needs_split(items: DataFrame, needed: bool = True) -> DataFrame:
    return items.where(F.col("group_count") > 1 if needed else F.col("group_count") <= 1)


def filter_keyword(products: DataFrame, keyword: str) -> DataFrame:
    """Keyword inside name, folder or store, ignoring case; an empty one keeps all."""
    kw = keyword.strip().lower()
    if not kw:
        return products
    hit = F.lit(False)
    for c in ("name", "folder", "store"):
        hit = hit | F.contains(F.lower(c), F.lit(kw))
    return products.where(hit)


def registrable(items: DataFrame, handled: DataFrame) -> DataFrame:
    """New items with a vector and no error, not registered or deleted before."""
    ok = (F.col("status") == S.NEW) & _no_error() & F.col("embedding").isNotNull()
    return items.where(ok).join(handled.select("folder").distinct(), "folder", "left_anti")


def eta(durations: DataFrame, idx: str, seconds: str, total: int, width: int = S.ETA_WINDOW) -> DataFrame:
    """Seconds left before each item: mean of the earlier durations times items to go."""
    from .ordering import previous_mean

    return previous_mean(durations, idx, seconds, "mean_seconds", width).withColumn(
        "eta_seconds", F.col("mean_seconds") * (F.lit(total) - F.col(idx))
    )
