"""Crawled pages and download results, worked off as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import html
from ..operators.ordering import latest_per_key
from . import tables

ALBUM_FIELDS = "album_id string, page bigint, pos int, title string, url string, image_count bigint, cover_url string"
LOG_FIELDS = "key string, status string, downloaded bigint, image_count bigint, updated_at timestamp"


def ingest_albums(pages: DataFrame, base: str, path: str, checkpoint: str) -> DataFrame:
    """Albums of a stream of listing pages (page, html); a retried batch replaces itself.

    Each batch adds the rows it saw first; reading keeps the first row of an album over
    all batches, so the result does not depend on how pages fell into batches.
    """
    spark = pages.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # A file of pages is one or two tasks, and reading pages is slow: all cores take part.
        cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = html.first_seen(html.albums(batch.repartition(cores, "page"), base)).select(*_names(ALBUM_FIELDS))
        tables.put(found, path, batch_id)

    tables.run_available(pages.select(F.col("page").cast("bigint").alias("page"), "html"), on_batch, checkpoint)
    return html.first_seen(tables.get(spark, path, ALBUM_FIELDS))


def download_log(results: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """State per album from a stream of image results (key, outcome, ts).

    The running totals live in the aggregation state; each batch writes the albums that
    changed, and reading takes the newest row of an album.
    """
    spark = results.sparkSession
    totals = results.groupBy("key").agg(
        F.count(F.lit(1)).alias("image_count"),
        F.count_if(F.col("outcome") != "failed").alias("downloaded"),
        F.max(F.col("ts").cast("timestamp")).alias("updated_at"),
    )

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        done = F.col("downloaded") == F.col("image_count")
        rows = batch.withColumn("status", F.when(done, "done").otherwise("partial")).select(*_names(LOG_FIELDS))
        tables.put(rows.withColumn("seq", F.lit(batch_id).cast("bigint")), path, batch_id)

    tables.run_available(totals, on_batch, checkpoint, mode="update")
    rows = tables.get(spark, path, LOG_FIELDS + ", seq bigint")
    return latest_per_key(rows, ["key"], [F.col("seq").desc()]).drop("seq")


def first_seen_keys(rows: DataFrame, key: str, time: str, delay: str | None = None) -> DataFrame:
    """Stream of the first row per key. Keys are never forgotten, and the state holds each
    once, unless ``delay`` is given: then keys older than that leave the state."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))
    if delay is None:
        return timed.dropDuplicates([key])
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]
