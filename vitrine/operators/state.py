"""Small app state as tables: download log, upload marks, URL history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .ordering import latest_per_key


def log_key(user, album_id):
    return F.concat_ws(":", user, album_id)


def join_log(albums: DataFrame, log: DataFrame) -> DataFrame:
    """Albums with their log entry, if any."""
    return albums.join(log, "key", "left")


def pending(albums: DataFrame, log: DataFrame) -> DataFrame:
    """Albums to fetch: those not logged as done."""
    return join_log(albums, log).where(F.coalesce("status", F.lit("")) != S.DONE)


def selection(albums: DataFrame) -> DataFrame:
    return albums.agg(
        F.count(F.lit(1)).alias("albums"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images")
    )


def download_summary(results: DataFrame, album: str = "key") -> DataFrame:
    """Totals per album and, where ``album`` is NULL, over everything, in one pass."""
    is_ = lambda s: F.count_if(F.col("outcome") == s)
    return results.rollup(album).agg(
        F.count(F.lit(1)).alias("total"),
        is_("success").alias("success"),
        is_("skipped").alias("skipped"),
        is_("failed").alias("failed"),
    )


def download_errors(results: DataFrame, album: str = "key") -> DataFrame:
    """Error lines, one row each: a failing album may have any number of them."""
    return results.where(F.col("outcome") == "failed").select(
        album, F.format_string("[%s/%s] %s", F.col(album), F.col("file"), F.col("error")).alias("line")
    )


def download_status(summary: DataFrame) -> DataFrame:
    """Images held and state per album; done only when every image is held."""
    held = F.col("success") + F.col("skipped")
    return summary.withColumn("downloaded", held).withColumn(
        "status", F.when(held == F.col("total"), S.DONE).otherwise(S.PARTIAL)
    )


def current(entries: DataFrame, key: list[str], order: list) -> DataFrame:
    """State to save: the last write of every key."""
    return latest_per_key(entries, key, order)


def url_history(visits: DataFrame, keep: int = S.URL_HISTORY_MAX) -> DataFrame:
    """Most recently used URLs, newest first."""
    return (
        visits.groupBy("url").agg(F.max("used_at").alias("last_used"))
        .orderBy(F.col("last_used").desc(), "url")
        .limit(keep)
    )


def resume_folders(albums: DataFrame, log: DataFrame, existing: DataFrame, assigned: DataFrame) -> DataFrame:
    """Logged folder if it still exists, else the newly assigned one (both by ``key``)."""
    there = existing.select(F.col("folder").alias("logged")).distinct()
    logged = log.select("key", F.col("folder").alias("logged")).join(there, "logged", "left_semi")
    return (
        albums.join(logged, "key", "left")
        .join(assigned.select("key", "assigned"), "key", "left")
        .withColumn("folder", F.coalesce("logged", "assigned"))
        .withColumn("resumed", F.col("logged").isNotNull())
    )


def missing_images(wanted: DataFrame, valid_files: DataFrame) -> DataFrame:
    """Images still to fetch: no valid file of that path."""
    return wanted.join(valid_files.select("path"), "path", "left_anti")


def join_marks(listings: DataFrame, marks: DataFrame) -> DataFrame:
    """Listings with an ``uploaded`` flag by (parent_dir, folder)."""
    m = marks.select("parent_dir", "folder").distinct().withColumn("_m", F.lit(True))
    return listings.join(m, ["parent_dir", "folder"], "left").withColumn(
        "uploaded", F.coalesce("_m", F.lit(False))
    ).drop("_m")


def clear_marks(marks: DataFrame, selected: DataFrame) -> DataFrame:
    """Marks left after clearing some folders, or whole directories if only those are given."""
    on = [c for c in ("parent_dir", "folder") if c in selected.columns]
    return marks.join(selected.select(*on).distinct(), on, "left_anti")


def relocated_folders(records: DataFrame, existing: DataFrame, base: str) -> DataFrame:
    """Where a recorded folder is now: as recorded, under ``base``, or missing."""
    seen = existing.select(F.col("folder").alias("at")).distinct()
    moved = F.concat(F.lit(base.rstrip("/") + "/"), F.substring_index("folder", "/", -1))
    a = seen.withColumnRenamed("at", "as_recorded")
    b = seen.withColumnRenamed("at", "under_base")
    return (
        records.join(a, F.col("folder") == F.col("as_recorded"), "left")
        .join(b, moved == F.col("under_base"), "left")
        .withColumn("location", F.coalesce("as_recorded", "under_base"))
        .drop("as_recorded", "under_base")
    )


def distinct_hosts(urls: DataFrame, url: str, order: str) -> DataFrame:
    """Every host once, with the first URL that names it."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return (
        urls.withColumn("host", host)
        .where(F.col("host") != "")
        .groupBy("host")
        .agg(F.min_by(url, order).alias("sample_url"))
    )
