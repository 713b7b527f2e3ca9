"""The same inputs worked off as streams, batch by batch, until none is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.session import scratch_path
from vitrine.streaming import ingest, register, tables

from . import views as W
from .page_queries import album_pages
from .registry import query
from .views import table, with_views


@query("ingest_stream", with_views("shown album_rows", """
SELECT album_id, page, pos, title, image_count FROM album_rows QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY page, pos) = 1"""))
def _(spark, sf):
    path = scratch_path(spark, "ingest")
    album_pages(spark, sf).repartition(3, "page").write.parquet(f"{path}/pages")
    pages = tables.file_stream(spark, f"{path}/pages", "page bigint, html string")
    return ingest.ingest_albums(pages, W.BASE, f"{path}/albums", f"{path}/progress").select("album_id", "page", "pos", "title", "image_count")


def event_stream(spark, sf):
    """The events in three files, a batch each; keys return in later ones."""
    path = scratch_path(spark, "events")
    events = table(spark, sf, "events")
    events.repartition(3, "event_id").write.parquet(path)
    return tables.file_stream(spark, path, events.schema)


@query("stream_dedup_seen", "SELECT user_id, 1::BIGINT AS times FROM events GROUP BY user_id")
def _(spark, sf):
    path = scratch_path(spark, "seen")
    seen = ingest.first_seen_keys(event_stream(spark, sf), "user_id", "ts").select("user_id")
    tables.run_available(seen, lambda b, i: tables.put(b, f"{path}/rows", i), f"{path}/progress")
    return tables.get(spark, f"{path}/rows", "user_id bigint").groupBy("user_id").agg(F.count(F.lit(1)).alias("times"))


@query("download_log_stream", with_views("downloads dlog", """
SELECT key, status, downloaded, image_count, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM dlog"""))
def _(spark, sf):
    path = scratch_path(spark, "log")
    kind = F.col("event_type")
    results = event_stream(spark, sf).select(
        F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string")).alias("key"),
        F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("success").alias("outcome"), "ts",
    )
    log = ingest.download_log(results, f"{path}/rows", f"{path}/progress")
    return log.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("register_stream", with_views("products incoming", """
SELECT folder, min(id) AS lowest, count(*) FILTER (added) AS added, count(*) FILTER (NOT added) AS conflicts FROM (
 SELECT folder, (SELECT max(id) FROM products) AS id, folder NOT IN (SELECT folder FROM products) AND row_number() OVER (PARTITION BY folder ORDER BY row) = 1 AS added FROM incoming) GROUP BY folder"""))
def _(spark, sf):
    path = scratch_path(spark, "register")
    rows = W.incoming(spark, sf)
    rows.repartition(3, "row").write.parquet(f"{path}/incoming")
    stream = tables.file_stream(spark, f"{path}/incoming", rows.schema)
    products = W.products(spark, sf)
    added, conflicts = register.register(stream, products, "row", f"{path}/out", f"{path}/progress")
    # Every id given out is new and used once.
    low = products.agg(F.max("id").alias("m")).first()["m"]
    ids = added.agg(F.min("id").alias("low"), F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("m")).first()
    if ids["low"] <= low or ids["n"] != ids["m"]:
        raise AssertionError("ids were given out twice")
    per = added.select("folder", F.lit(1).alias("ok")).unionByName(conflicts.select("folder", F.lit(0).alias("ok"))).groupBy("folder").agg(
        F.sum("ok").alias("added"), (F.count(F.lit(1)) - F.sum("ok")).alias("conflicts")
    )
    return per.select("folder", F.lit(low).alias("lowest"), "added", "conflicts")
