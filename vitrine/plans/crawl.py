"""Listing pages to the albums worth fetching, and fetched images to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import urls as U
from ..functions.text import image_filename
from ..operators import html, naming, phash, state
from ..operators.ordering import numbered


def albums_to_fetch(pages: DataFrame, base: str, user: str, log: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Albums of all pages in crawl order, with log status and the reason to leave one out.

    ``covers`` is (album_id, hash). An album is picked unless it is logged as done or
    repeats an earlier title or cover.
    """
    seen = html.first_seen(html.albums(pages, base))
    rows = numbered(seen, [], [F.col("page"), F.col("pos")], "row", F.col("page"))
    keyed = rows.withColumn("key", state.log_key(F.lit(user), F.col("album_id")))
    logged = state.join_log(keyed, log.select("key", "status", F.col("folder").alias("logged")))
    if covers is None:
        logged = logged.withColumn("hash", F.lit(None).cast("array<bigint>"))
    else:
        logged = logged.join(covers.select("album_id", "hash"), "album_id", "left")
    flags = phash.album_duplicates(logged.select("row", "title", "status", "hash"))
    return logged.drop("hash").join(flags.select("row", "reason", "match_row"), "row").withColumn(
        "picked", (F.coalesce("status", F.lit("")) != S.DONE) & F.col("reason").isNull()
    )


def download_plan(picked: DataFrame, album_pages: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per image to fetch: folder, file name and link.

    ``album_pages`` is (album_id, html); ``existing`` lists the folders already there. A
    logged folder that still exists is used again, others get a free name.
    """
    todo = picked.where("picked")
    there = existing.select(F.col("folder").alias("logged")).distinct().withColumn("_there", F.lit(True))
    split = todo.join(there, "logged", "left")
    resumed = split.where("_there").select("row", "album_id", F.col("logged").alias("folder"))
    fresh = split.where(F.col("_there").isNull()).select("row", "album_id", "title")
    named = naming.unique_folders(
        fresh, "row", "title", "folder", existing=existing.select("folder").distinct()
    ).select("row", "album_id", "folder")
    images = html.album_images(album_pages, "album_id")
    # Positions count the links that are kept.
    placed = numbered(images, ["album_id"], [F.col("pos")], "n", F.floor(F.col("pos") / S.CHUNK_ROWS))
    return resumed.unionByName(named).join(placed, "album_id").select(
        "row", "album_id", "folder", "image_url",
        image_filename(F.col("n") - 1, U.url_extension(F.col("image_url"))).alias("file"),
    )


def log_entries(results: DataFrame) -> DataFrame:
    """Log rows of fetched albums from their image results."""
    return state.download_status(state.download_summary(results).where(F.col("key").isNotNull()))
