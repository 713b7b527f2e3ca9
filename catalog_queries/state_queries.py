"""Sources, sinks, state, joins, counters and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import features as feat
from vitrine.operators import history, listing, naming, registry, state, summaries
from vitrine.session import scratch_path
from vitrine.sources import files as fs
from vitrine.sources import state_files
from vitrine.sources.pages import listing_pages

from . import views as W
from .registry import query
from .text_queries import items
from .views import table, with_views

TS = "yyyy-MM-dd HH:mm:ss"


def ts(col):
    return F.date_format(col, TS)


# ── files and pages ───────────────────────────────────────────

@query("image_file_scan", with_views("files", """
SELECT path, length FROM files WHERE lower(ext) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp')"""))
def _(spark, sf):
    return fs.image_files(W.files(spark, sf)).select("path", "length")


@query("image_folder_scan", with_views("files", """
SELECT folder, count(*) AS image_count FROM files WHERE lower(ext) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp') GROUP BY folder"""))
def _(spark, sf):
    return fs.image_folders(W.files(spark, sf).select("path"))


# Every seventh page came without a document.
@query("page_scan", """
SELECT page_id, CASE WHEN page_id % 7 > 0 THEN row_number() OVER (PARTITION BY page_id % 7 > 0 ORDER BY page_id) END AS page, url,
 CASE WHEN page_id % 7 > 0 THEN length(html) ELSE 0 END AS n_chars FROM pages""")
def _(spark, sf):
    html = F.when(F.col("page_id") % 7 > 0, F.col("html")).otherwise(F.when(F.col("page_id") % 2 == 0, "  "))
    found, blank = listing_pages(table(spark, sf, "pages").withColumn("html", html), "page_id")
    both = found.unionByName(blank, allowMissingColumns=True)
    return both.select(F.col("place").alias("page_id"), "page", "url", F.coalesce(F.length("html"), F.lit(0)).alias("n_chars"))


# ── registry ──────────────────────────────────────────────────

@query("registry_scan", with_views("products", "SELECT id, name, store, folder, image_count FROM products"))
def _(spark, sf):
    return registry.by_id(W.products(spark, sf).drop("price"))


@query("registry_vectors", """
SELECT p_partkey AS id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM part JOIN embeddings ON vec_id = p_partkey""")
def _(spark, sf):
    e = W.vecs(spark, sf).select("id", F.col("v").alias("embedding"))
    stored = W.products(spark, sf).join(e, "id", "left")
    return registry.vectors(stored).select(
        "id", F.size("embedding").alias("dim"), (F.round(F.get("embedding", 0).cast("double"), 6) + 0.0).alias("first")
    )


@query("registry_append", with_views("products incoming", """
SELECT row, folder, CASE WHEN rn = 1 THEN (SELECT max(id) FROM products) + row_number() OVER (PARTITION BY rn = 1 ORDER BY row) ELSE -1 END AS id FROM (
 SELECT row, folder, CASE WHEN known THEN 0 ELSE row_number() OVER (PARTITION BY folder ORDER BY row) END AS rn FROM (
  SELECT row, folder, folder IN (SELECT folder FROM products) AS known FROM incoming))"""))
def _(spark, sf):
    added, conflicts = registry.append(W.incoming(spark, sf), W.products(spark, sf), "row")
    return added.select("row", "folder", "id").unionByName(conflicts.select("row", "folder", F.lit(-1).cast("bigint").alias("id")))


W.SQL["gone"] = "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"


def gone(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()


@query("registry_delete", with_views("products files gone", """
SELECT p.id, p.folder, count(f.path) AS images FROM products p LEFT JOIN files f ON f.row // 8 = p.id
WHERE p.id NOT IN (SELECT id FROM gone) GROUP BY 1, 2"""))
def _(spark, sf):
    ids = gone(spark, sf)
    parents = registry.delete(W.products(spark, sf), ids)
    children = registry.delete(W.files(spark, sf).select(F.floor(F.col("row") / 8).alias("product_id"), "path"), ids, "product_id")
    n = children.groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("images"))
    return parents.join(n, "id", "left").select("id", "folder", F.coalesce("images", F.lit(0)).alias("images"))


@query("registry_replace", with_views("products", """
SELECT id, name, store, folder, image_count, price FROM products WHERE id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 10000000 + s_suppkey, s_name, 'supplier', concat('s', s_suppkey), s_nationkey, s_acctbal FROM supplier"""))
def _(spark, sf):
    pairs = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("old_id"), (F.lit(10000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.lit("supplier").alias("store"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("folder"),
        F.col("s_nationkey").alias("image_count"), F.col("s_acctbal").alias("price"),
    )
    return registry.replace(W.products(spark, sf), pairs)


@query("join_new_folders", with_views("products incoming", """
SELECT row, folder FROM incoming WHERE folder NOT IN (SELECT folder FROM products)"""))
def _(spark, sf):
    return registry.new_folders(W.incoming(spark, sf), W.products(spark, sf)).select("row", "folder")


@query("join_match_products", with_views("products", """
SELECT l_orderkey AS qid, l_linenumber AS n, match_id, CASE WHEN s_suppkey IS NOT NULL THEN concat('s', s_suppkey) ELSE folder END AS folder, coalesce(s_name, name) AS name FROM (
 SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 - l_suppkey ELSE 2 * l_partkey END AS match_id FROM lineitem)
LEFT JOIN supplier ON -1 - s_suppkey = match_id LEFT JOIN products ON id = match_id WHERE s_suppkey IS NOT NULL OR id IS NOT NULL"""))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    wanted = F.when(F.col("l_returnflag") == "R", F.lit(-1) - F.col("l_suppkey")).otherwise(F.col("l_partkey") * 2)
    matches = li.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("n"), wanted.alias("match_id"))
    batch = table(spark, sf, "supplier").select(
        (F.lit(-1) - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("").alias("store"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("folder"),
    )
    return registry.resolve_matches(matches, batch, W.products(spark, sf)).select("qid", "n", "match_id", "folder", "name")


@query("join_index_audit", """
SELECT coalesce(p_partkey, o_custkey) AS id, CASE WHEN o_custkey IS NULL THEN 'index' ELSE 'registry' END AS missing_in
FROM part FULL JOIN (SELECT DISTINCT o_custkey + 900 AS o_custkey FROM orders) ON p_partkey = o_custkey WHERE p_partkey IS NULL OR o_custkey IS NULL""")
def _(spark, sf):
    indexed = table(spark, sf, "orders").select((F.col("o_custkey") + 900).alias("id")).distinct()
    return registry.index_audit(indexed, W.products(spark, sf))


@query("flt_keyword", with_views("products", "SELECT id FROM products WHERE contains(lower(name), 'ing') OR contains(lower(folder), 'ing') OR contains(lower(store), 'ing')"))
def _(spark, sf):
    return summaries.filter_keyword(W.products(spark, sf), " ING ").select("id")


# ── state files ───────────────────────────────────────────────

def log_json(spark, sf):
    """One JSON text per user, and one that is no JSON per customer segment."""
    entry = F.struct(
        F.substring_index("key", ":", -1).alias("album_id"), F.substring_index("key", ":", 1).alias("username"),
        F.lit("t").alias("title"), "folder", "image_count", "downloaded", "status", ts("updated_at").alias("updated_at"),
    )
    log = W.dlog(spark, sf).groupBy(F.substring_index("key", ":", 1).alias("u"))
    good = log.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", entry)))).alias("raw")).select("raw")
    torn = table(spark, sf, "customer").select(F.concat(F.lit('{"a:1": {"album_id": '), "c_mktsegment").alias("raw"))
    return good.unionByName(torn)


@query("state_load", with_views("downloads dlog", """
SELECT key, folder, image_count, downloaded, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM dlog"""))
def _(spark, sf):
    path = scratch_path(spark, "state")
    log_json(spark, sf).write.text(path)
    loaded = state_files.load_log(spark.read.text(path).withColumnRenamed("value", "raw"))
    return loaded.select("key", "folder", "image_count", "downloaded", "status", "updated_at")


@query("state_save", with_views("downloads", """
SELECT key, event_id, outcome FROM downloads QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1"""))
def _(spark, sf):
    path = scratch_path(spark, "saved")
    now = state.current(W.downloads(spark, sf), ["key"], [F.col("ts").desc(), F.col("event_id").desc()])
    state_files.save(now.select("key", "event_id", "outcome"), path)
    return spark.read.parquet(path)


@query("marks_clear", with_views("marks", """
SELECT parent_dir, folder FROM marks WHERE parent_dir NOT IN (SELECT concat('Brand#', s_nationkey) FROM supplier WHERE s_acctbal < 0)
AND (parent_dir, folder) NOT IN (SELECT p_brand, concat('f', p_partkey) FROM part WHERE p_size > 40)"""))
def _(spark, sf):
    dirs = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("parent_dir"))
    picked = W.listings(spark, sf).where("n_images > 40")
    return state.clear_marks(state.clear_marks(W.marks(spark, sf), picked), dirs).select("parent_dir", "folder")


@query("topk_url_history", """
SELECT url, strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used FROM (
SELECT concat('https://shop.example.com/', user_id) AS url, max(ts) AS last_used FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""")
def _(spark, sf):
    visits = table(spark, sf, "events").select(
        F.concat(F.lit("https://shop.example.com/"), F.col("user_id").cast("string")).alias("url"), F.col("ts").alias("used_at")
    )
    return state.url_history(visits).select("url", ts("last_used").alias("last_used"))


@query("set_distinct_hosts", r"""
SELECT host, arg_min(url, page_id) AS sample_url FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages) GROUP BY host""")
def _(spark, sf):
    return state.distinct_hosts(table(spark, sf, "pages"), "url", "page_id")


# ── download log ──────────────────────────────────────────────

@query("join_download_log", with_views("downloads dlog shop", """
SELECT row, key, coalesce(status, '') AS status, coalesce(downloaded, 0) AS downloaded FROM shop LEFT JOIN dlog USING (key)"""))
def _(spark, sf):
    log = W.dlog(spark, sf).select("key", "status", "downloaded")
    return state.join_log(W.shop(spark, sf), log).select(
        "row", "key", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("downloaded", F.lit(0)).alias("downloaded")
    )


@query("flt_pending_albums", with_views("downloads dlog shop", """
SELECT row FROM shop LEFT JOIN dlog USING (key) WHERE coalesce(status, '') <> 'done'"""))
def _(spark, sf):
    return state.pending(W.shop(spark, sf), W.dlog(spark, sf).select("key", "status")).select("row")


@query("agg_selection", with_views("downloads dlog shop", """
SELECT count(*) AS albums, coalesce(sum(shop.image_count), 0)::BIGINT AS images FROM shop LEFT JOIN dlog USING (key) WHERE coalesce(status, '') <> 'done'"""))
def _(spark, sf):
    return state.selection(state.pending(W.shop(spark, sf), W.dlog(spark, sf).select("key", "status")))


@query("agg_download_batch", with_views("downloads", """
SELECT coalesce(key, 'total') AS key, count(*) AS total, count(*) FILTER (outcome = 'success') AS success,
 count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM downloads GROUP BY ROLLUP (key)"""))
def _(spark, sf):
    return state.download_summary(W.downloads(spark, sf)).withColumn("key", F.coalesce("key", F.lit("total")))


@query("agg_download_errors", with_views("downloads", """
SELECT key, concat('[', key, '/', file, '] ', error) AS line FROM downloads WHERE outcome = 'failed'"""))
def _(spark, sf):
    return state.download_errors(W.downloads(spark, sf))


@query("agg_download_status", with_views("downloads dlog", "SELECT key, image_count AS total, downloaded, status FROM dlog"))
def _(spark, sf):
    s = state.download_summary(W.downloads(spark, sf)).where("key IS NOT NULL")
    return state.download_status(s).select("key", "total", "downloaded", "status")


@query("join_resume_folder", with_views("downloads dlog shop", """
SELECT row, coalesce(logged, concat('new-', row)) AS folder, logged IS NOT NULL AS resumed FROM shop LEFT JOIN (
 SELECT key, folder AS logged FROM dlog WHERE folder IN (SELECT concat('dir', c_custkey) FROM customer WHERE c_acctbal > 0)) USING (key)"""))
def _(spark, sf):
    shop = W.shop(spark, sf)
    there = table(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("dir"), F.col("c_custkey").cast("string")).alias("folder"))
    keyed = shop.select(F.concat_ws("/", "key", F.col("row").cast("string")).alias("album"), "key", "row")
    log = W.dlog(spark, sf).join(keyed, "key").select(F.col("album").alias("key"), "folder")
    fresh = keyed.select(F.col("album").alias("key"), F.concat(F.lit("new-"), F.col("row").cast("string")).alias("assigned"))
    albums = keyed.select(F.col("album").alias("key"), "row")
    return state.resume_folders(albums, log, there, fresh).select("row", "folder", "resumed")


@query("join_resume_images", with_views("files", """
SELECT path FROM files WHERE NOT ((starts_with(head, 'FFD8FF') OR starts_with(head, '89504E470D0A') OR starts_with(head, '52494646') OR starts_with(head, '424D')) AND length(head) >= 8)"""))
def _(spark, sf):
    f = W.files(spark, sf)
    return state.missing_images(f.select("path"), fs.valid_images(f)).select("path")


@query("join_upload_marks", with_views("listings marks", """
SELECT l.row, m.folder IS NOT NULL AS uploaded FROM listings l LEFT JOIN marks m USING (parent_dir, folder)"""))
def _(spark, sf):
    return state.join_marks(W.listings(spark, sf), W.marks(spark, sf)).select("row", "uploaded")


@query("join_relocated_folder", """
SELECT o_orderkey AS row, CASE WHEN c.c_custkey IS NOT NULL THEN concat('/old/', o_custkey % 2000)
  WHEN s.s_suppkey IS NOT NULL THEN concat('/base/', o_custkey % 2000) ELSE 'missing' END AS location
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c.c_custkey = o_custkey
LEFT JOIN supplier s ON s.s_suppkey = o_custkey""".replace(" % 2000", ""))
def _(spark, sf):
    path = lambda base, c: F.concat(F.lit(base), F.col(c).cast("string")).alias("folder")
    records = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), path("/old/", "o_custkey"))
    old = table(spark, sf, "customer").where("c_acctbal > 5000").select(path("/old/", "c_custkey"))
    new = table(spark, sf, "supplier").select(path("/base/", "s_suppkey"))
    return state.relocated_folders(records, old.unionByName(new), "/base").select("row", F.coalesce("location", F.lit("missing")).alias("location"))


# ── feature store ─────────────────────────────────────────────

W.SQL["wanted"] = """
SELECT concat('img/', p_partkey) AS key, ns AS namespace, 1700000000.5 + p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS mtime
FROM part CROSS JOIN (VALUES (''), ('combined')) t(ns)"""


def wanted(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").withColumn("namespace", F.explode(F.array(F.lit(""), F.lit("combined")))).select(
        F.concat(F.lit("img/"), k.cast("string")).alias("key"), "namespace",
        (F.lit(1700000000.5) + k + F.when(k % 7 == 0, 1).otherwise(0)).alias("mtime"),
    )


_FRESH = f"written_at >= TIMESTAMP '{W.NOW}' - INTERVAL 90 DAY"


@query("join_feature_cache", with_views("vecs store wanted", f"""
SELECT w.key, w.namespace, s.key IS NOT NULL AS hit, coalesce(len(s.feature), 0) AS dim FROM wanted w LEFT JOIN store s
ON s.key = w.key AND s.namespace = w.namespace AND s.mtime = w.mtime AND s.{_FRESH}"""))
def _(spark, sf):
    out = feat.lookup(wanted(spark, sf), W.store(spark, sf), W.now())
    return out.select("key", "namespace", "hit", F.coalesce(F.size("feature"), F.lit(0)).alias("dim"))


@query("set_cache_merge", with_views("vecs store wanted", f"""
SELECT w.key, w.namespace, CASE WHEN s.key IS NOT NULL THEN len(s.feature) ELSE 1 END AS dim FROM wanted w LEFT JOIN store s
ON s.key = w.key AND s.namespace = w.namespace AND s.mtime = w.mtime AND s.{_FRESH}"""))
def _(spark, sf):
    out = feat.lookup(wanted(spark, sf), W.store(spark, sf), W.now())
    found = out.where("hit").drop("hit")
    computed = out.where("NOT hit").drop("hit").withColumn("feature", F.array(F.lit(0.5).cast("float")))
    return feat.merge(found, computed, "key").select("key", "namespace", F.size("feature").alias("dim"))


@query("feature_upsert", with_views("vecs store wanted", f"""
SELECT coalesce(w.key, s.key) AS key, coalesce(w.namespace, s.namespace) AS namespace, coalesce(w.mtime, s.mtime) AS mtime
FROM store s FULL JOIN (SELECT * FROM wanted WHERE namespace = 'combined') w ON s.key = w.key AND s.namespace = w.namespace"""))
def _(spark, sf):
    rows = wanted(spark, sf).where("namespace = 'combined'").withColumn("written_at", W.now()).withColumn(
        "feature", F.array(F.lit(0.5).cast("float"))
    )
    return feat.upsert(W.store(spark, sf), rows).select("key", "namespace", "mtime")


@query("feature_clear", with_views("vecs store", "SELECT namespace, count(*) AS size FROM store WHERE namespace <> 'combined' GROUP BY 1"))
def _(spark, sf):
    return feat.clear(W.store(spark, sf), "combined").groupBy("namespace").agg(F.count(F.lit(1)).alias("size"))


@query("feature_ttl", with_views("vecs store", f"SELECT key, namespace FROM store WHERE {_FRESH}"))
def _(spark, sf):
    return feat.unexpired(W.store(spark, sf), W.now()).select("key", "namespace")


# ── split history ─────────────────────────────────────────────

# New splits: every event user's folder again, and one sub-folder each.
W.SQL["splits"] = """
SELECT 2 * event_id AS row, concat('c/', user_id) AS folder, ts AS split_time, 2 AS group_count, event_id % 9 AS image_count FROM events
UNION ALL SELECT 2 * event_id + 1, concat('c/', user_id, ' ', event_type), ts, 1, 1 FROM events"""


def splits(spark, sf):
    e = table(spark, sf, "events")
    key = F.concat(F.lit("c/"), F.col("user_id").cast("string"))
    whole = e.select((F.col("event_id") * 2).alias("row"), key.alias("folder"), F.col("ts").alias("split_time"),
                     F.lit(2).cast("bigint").alias("group_count"), (F.col("event_id") % 9).cast("int").alias("image_count"))
    part = e.select((F.col("event_id") * 2 + 1).alias("row"), F.concat(key, F.lit(" "), F.col("event_type")).alias("folder"),
                    F.col("ts").alias("split_time"), F.lit(1).cast("bigint").alias("group_count"), F.lit(1).alias("image_count"))
    return whole.unionByName(part).withColumn("has_features", F.lit(False))


@query("split_history_write", with_views("history hgroups himages splits", """
SELECT 'history' AS tbl, folder, group_count AS n, image_count AS m FROM (
  SELECT folder, group_count, image_count FROM history WHERE folder NOT IN (SELECT folder FROM splits)
  UNION ALL SELECT folder, group_count, image_count FROM splits QUALIFY row_number() OVER (PARTITION BY folder ORDER BY row DESC) = 1)
UNION ALL SELECT 'groups', folder, count(*), 0 FROM (
  SELECT folder, group_id FROM hgroups JOIN history USING (history_id) WHERE folder NOT IN (SELECT folder FROM splits)
  UNION ALL SELECT folder, unnest([0, 1]) FROM (SELECT folder FROM splits QUALIFY row_number() OVER (PARTITION BY folder ORDER BY row DESC) = 1)) GROUP BY 2
UNION ALL SELECT 'images', folder, count(*), 0 FROM (
  SELECT folder FROM himages JOIN history USING (history_id) WHERE folder NOT IN (SELECT folder FROM splits)
  UNION ALL SELECT folder FROM splits QUALIFY row_number() OVER (PARTITION BY folder ORDER BY row DESC) = 1) GROUP BY 2"""))
def _(spark, sf):
    new = splits(spark, sf)
    g = new.select("row", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("group_id")).withColumn("group_name", F.lit("g"))
    i = new.select("row", F.lit(0).cast("bigint").alias("group_id"), F.col("folder").alias("file_path"))
    h2, g2, i2 = history.write(W.history(spark, sf), W.hgroups(spark, sf), W.himages(spark, sf), new, g, i, "row")
    name = h2.select("history_id", "folder")
    count = lambda t, label: t.join(name, "history_id").groupBy("folder").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(label).alias("tbl"), "folder", "n", F.lit(0).alias("m")
    )
    rows = h2.select(F.lit("history").alias("tbl"), "folder", F.col("group_count").alias("n"), F.col("image_count").alias("m"))
    return rows.unionByName(count(g2, "groups")).unionByName(count(i2, "images"))


@query("split_history_read", with_views("history hgroups himages", """
SELECT h.history_id, h.folder, g.group_id, g.group_name, count(i.file_path) AS images
FROM history h JOIN hgroups g USING (history_id) LEFT JOIN himages i ON i.history_id = h.history_id AND i.group_id = g.group_id GROUP BY 1, 2, 3, 4"""))
def _(spark, sf):
    h = W.history(spark, sf)
    g = history.groups_of(h, W.hgroups(spark, sf))
    n = history.images_of(h, W.himages(spark, sf)).groupBy("history_id", "group_id").agg(F.count(F.lit(1)).alias("images"))
    return g.join(n, ["history_id", "group_id"], "left").select(
        "history_id", "folder", "group_id", "group_name", F.coalesce("images", F.lit(0)).alias("images")
    )


@query("split_history_update", with_views("history hgroups himages", """
SELECT history_id, folder, has_features OR folder IN (SELECT concat('c/', user_id) FROM events) AS has_features,
 (SELECT count(*) FROM himages i WHERE i.history_id = h.history_id) AS images FROM history h
WHERE folder NOT IN (SELECT concat('c/', s_suppkey) FROM supplier)"""))
def _(spark, sf):
    touched = table(spark, sf, "events").select(F.concat(F.lit("c/"), F.col("user_id").cast("string")).alias("folder"))
    dropped = table(spark, sf, "supplier").select(F.concat(F.lit("c/"), F.col("s_suppkey").cast("string")).alias("folder"))
    h = history.set_has_features(W.history(spark, sf), touched, True)
    h2, _, i2 = history.delete(h, W.hgroups(spark, sf), W.himages(spark, sf), dropped)
    n = i2.groupBy("history_id").agg(F.count(F.lit(1)).alias("images"))
    return h2.join(n, "history_id", "left").select("history_id", "folder", "has_features", F.coalesce("images", F.lit(0)).alias("images"))


@query("join_split_history", with_views("history", """
SELECT c_custkey, CASE WHEN concat('c/', c_custkey) IN (SELECT folder FROM history) THEN 'split' ELSE 'todo' END AS state FROM customer"""))
def _(spark, sf):
    folders = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("folder"))
    h = W.history(spark, sf)
    return history.unsplit(folders, h).select("c_custkey", F.lit("todo").alias("state")).unionByName(
        history.already_split(folders, h).select("c_custkey", F.lit("split").alias("state"))
    )


@query("sort_history", with_views("history", """
SELECT row_number() OVER (ORDER BY split_time DESC, history_id DESC) AS n, history_id, strftime(split_time, '%Y-%m-%d %H:%M:%S') AS split_time FROM history"""))
def _(spark, sf):
    from vitrine.operators.ordering import numbered

    h = W.history(spark, sf).withColumn("split_time", F.col("split_time").cast("timestamp"))
    # Later days come first, so the day counted backwards keeps the order.
    day = -F.unix_date(F.to_date("split_time"))
    return numbered(h, [], [F.col("split_time").desc(), F.col("history_id").desc()], "n", day).select("n", "history_id", ts("split_time").alias("split_time"))


# ── counters ──────────────────────────────────────────────────

@query("agg_split_summary", with_views("items", "SELECT count(*) AS folders, count(*) FILTER (group_count > 1) AS need_split FROM items"))
def _(spark, sf):
    return summaries.split_summary(items(spark, sf))


W.SQL["processed"] = """
SELECT l_suppkey AS folder, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'processed' END AS outcome FROM lineitem"""


@query("agg_process_summary", with_views("processed", """
SELECT coalesce(folder, -1) AS folder, count(*) AS total, count(*) FILTER (outcome = 'processed') AS processed,
 count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM processed GROUP BY ROLLUP (folder)"""))
def _(spark, sf):
    flag = F.col("l_returnflag")
    images = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("folder"), F.when(flag == "R", "failed").when(flag == "A", "skipped").otherwise("processed").alias("outcome")
    )
    return summaries.process_summary(images).withColumn("folder", F.coalesce("folder", F.lit(-1)))


@query("agg_upload_summary", "SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders")
def _(spark, sf):
    return summaries.upload_summary(table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("success")))


_KINDS = ("all", "duplicate", "review", "new", "error")


@query("flt_dedup_status", with_views("items", """
SELECT 'all' AS shown, row FROM items UNION ALL SELECT 'duplicate', row FROM items WHERE status = 'duplicate'
UNION ALL SELECT 'review', row FROM items WHERE status = 'review' UNION ALL SELECT 'new', row FROM items WHERE status = 'new' AND error IS NULL
UNION ALL SELECT 'error', row FROM items WHERE error IS NOT NULL"""))
def _(spark, sf):
    parts = [summaries.filter_status(items(spark, sf), k).select(F.lit(k).alias("shown"), "row") for k in _KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("flt_needs_split", with_views("items", "SELECT row, group_count > 1 AS needed FROM items"))
def _(spark, sf):
    i = items(spark, sf)
    return summaries.filter_needs_split(i).select("row", F.lit(True).alias("needed")).unionByName(
        summaries.filter_needs_split(i, False).select("row", F.lit(False).alias("needed"))
    )


@query("flt_registrable", with_views("items", """
SELECT row FROM items WHERE status = 'new' AND error IS NULL AND NOT group_count = 2 AND folder NOT IN (SELECT concat('f', c_custkey * 3) FROM customer)"""))
def _(spark, sf):
    i = items(spark, sf).withColumn("embedding", F.when(F.col("group_count") != 2, F.array(F.lit(1.0))))
    handled = table(spark, sf, "customer").select(F.concat(F.lit("f"), (F.col("c_custkey") * 3).cast("string")).alias("folder"))
    return summaries.registrable(i, handled).select("row")


# ── ordered operators ─────────────────────────────────────────

@query("win_title_duplicates", with_views("albums", """
SELECT row, first_row, row <> first_row AS is_duplicate FROM (SELECT row, min(row) OVER (PARTITION BY title) AS first_row FROM albums)"""))
def _(spark, sf):
    from vitrine.operators import phash

    return phash.title_duplicates(W.albums(spark, sf).select("row", "title")).select("row", "first_row", "is_duplicate")


# Titles repeat by the dozen; some read like a numbered one already.
W.SQL["titled"] = """
SELECT p_partkey AS row, CASE WHEN p_size % 10 = 0 THEN concat(p_name, '_', 2 + p_size // 10) ELSE p_name END AS title FROM part"""


def titled(spark, sf):
    numbered_title = F.concat_ws("_", "p_name", (2 + F.floor(F.col("p_size") / 10)).cast("string"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.when(F.col("p_size") % 10 == 0, numbered_title).otherwise(F.col("p_name")).alias("title")
    )


@query("win_unique_folder", with_views(
    "titled",
    """
, walk(n, row, folder_name, taken) AS (
  SELECT 0::BIGINT, -1::BIGINT, ''::VARCHAR, (SELECT list(name) FROM existing)
  UNION ALL
  SELECT n, row, pick, list_append(taken, pick) FROM (
    SELECT s.n, s.row, w.taken, CASE WHEN NOT list_contains(w.taken, s.title) THEN s.title ELSE
      concat(s.title, '_', list_min(list_filter(range(2, 300), lambda k: NOT list_contains(w.taken, concat(s.title, '_', k))))) END AS pick
    FROM walk w JOIN steps s ON s.n = w.n + 1))
SELECT row, folder_name FROM walk WHERE n > 0""",
    existing="SELECT DISTINCT concat(p_name, '_', p_size % 5 + 2) AS name FROM part WHERE p_type = 'ECONOMY' AND p_size > 45",
    steps="SELECT row, title, row_number() OVER (ORDER BY row) AS n FROM titled",
))
def _(spark, sf):
    e = table(spark, sf, "part").where("p_type = 'ECONOMY' AND p_size > 45").select(
        F.concat_ws("_", "p_name", (F.col("p_size") % 5 + 2).cast("string")).alias("folder_name")
    ).distinct()
    return naming.unique_folders(titled(spark, sf), "row", "title", existing=e).select("row", "folder_name")


@query("win_reorder_main", with_views("files", """
SELECT path, n AS position, concat(lpad(n::VARCHAR, 3, '0'), '_', split_part(path, '/', 2)) AS new_name FROM (
 SELECT path, row_number() OVER (PARTITION BY folder ORDER BY (head LIKE '89504E47%') DESC, path) AS n FROM files)"""))
def _(spark, sf):
    f = W.files(spark, sf).select("folder", "path", F.hex("content").alias("head"))
    return naming.reorder_main(f, "folder", "path", F.col("head").startswith("89504E47")).select("path", "position", "new_name")


@query("win_rolling_eta", """
SELECT o_orderkey AS idx, round(m, 6) AS mean_seconds, round(m * ((SELECT count(*) FROM orders) - o_orderkey), 3) AS eta_seconds FROM (
 SELECT o_orderkey, coalesce(avg(sqrt(o_totalprice)) OVER (ORDER BY o_orderkey ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS m FROM orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.sqrt("o_totalprice").alias("seconds"))
    out = summaries.eta(o, "idx", "seconds", o.count())
    zero = F.lit(0.0)
    return out.select(
        "idx", F.round(F.coalesce("mean_seconds", zero), 6).alias("mean_seconds"), F.round(F.coalesce("eta_seconds", zero), 3).alias("eta_seconds")
    )


# ── listings ──────────────────────────────────────────────────

W.SQL["shots"] = """
SELECT l_suppkey AS folder, concat(l_orderkey, '-', l_partkey, '-', l_linenumber, '-', l_extendedprice::BIGINT, '.jpg') AS path FROM lineitem"""


def shots(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("folder"),
        F.concat(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")],
                             F.rint("l_extendedprice").cast("bigint").cast("string")), F.lit(".jpg")).alias("path"),
    )


@query("fn_main_detail_split", with_views("shots", """
SELECT folder, count(*) FILTER (n <= 5) AS n_main, count(*) FILTER (n > 5) AS n_detail, min(path) FILTER (n = 1) AS first_main, coalesce(max(path) FILTER (n > 5), '') AS last_detail FROM (
 SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) AS n FROM shots) WHERE n <= 105 GROUP BY folder"""))
def _(spark, sf):
    out = listing.listing_images(shots(spark, sf))
    return out.select(
        "folder", F.size("main_images").alias("n_main"), F.size("detail_images").alias("n_detail"),
        F.get("main_images", 0).alias("first_main"), F.coalesce(F.try_element_at("detail_images", F.lit(-1)), F.lit("")).alias("last_detail"),
    )


@query("topk_preview_images", with_views("shots", """
SELECT folder, path, n AS position, greatest(total - 20, 0) AS more FROM (
 SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY path) AS n, count(*) OVER (PARTITION BY folder) AS total FROM shots) WHERE n <= 20"""))
def _(spark, sf):
    return listing.preview(shots(spark, sf), "folder", "path")


@query("topk_select_listings", with_views("listings marks", """
SELECT * FROM (SELECT 'all' AS shown, row FROM listings ORDER BY row LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'fresh', row FROM listings WHERE (parent_dir, folder) NOT IN (SELECT parent_dir, folder FROM marks) ORDER BY row LIMIT 50)
UNION ALL SELECT 'uploaded', row FROM listings WHERE (parent_dir, folder) IN (SELECT parent_dir, folder FROM marks)"""))
def _(spark, sf):
    lst, marks = W.listings(spark, sf), W.marks(spark, sf)
    pick = lambda which: listing.select_listings(lst, marks, "row", which, 50).select(F.lit(which).alias("shown"), "row")
    return pick("all").unionByName(pick("fresh")).unionByName(pick("uploaded"))


@query("listing_feed", with_views("listings marks shots", """
SELECT l.row, l.folder, coalesce(nullif(trim(title), ''), l.folder) AS title, printf('%.2f', price) AS price,
 least(coalesce(c.n, 0), 5) AS n_main, least(greatest(coalesce(c.n, 0) - 5, 0), 100) AS n_detail, CASE WHEN m.folder IS NULL THEN 'waiting' ELSE 'uploaded' END AS state
FROM listings l LEFT JOIN (SELECT folder, count(*) AS n FROM shots GROUP BY 1) c ON l.folder = concat('f', c.folder) LEFT JOIN marks m ON m.parent_dir = l.parent_dir AND m.folder = l.folder"""))
def _(spark, sf):
    images = listing.listing_images(shots(spark, sf)).withColumn("folder", F.concat(F.lit("f"), F.col("folder").cast("string")))
    path = scratch_path(spark, "feed")
    listing.feed(W.listings(spark, sf).join(images, "folder", "left"), W.marks(spark, sf)).write.json(path)
    return spark.read.schema("row bigint, folder string, title string, price string, n_main int, n_detail int, state string").json(path)
