"""Product vectors, hash joins, ordered dedup, stored cells and naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import vectors as V
from vitrine.operators import cell_tree, cells, dedup, phash, similarity, zero_shot
from vitrine.plans import variants
from vitrine.session import cut, scratch_path

from . import views as W
from .registry import query
from .vector_queries import registry_items
from .views import with_views

# ── product vectors ───────────────────────────────────────────

# Images of label 3 are corrupt (zero); folders whose images all are keep a zero vector.
W.SQL["weighted"] = "SELECT folder, pos, image_id, list_transform(images.v, lambda x: x * (label <> 3)::INT) AS v FROM images JOIN vecs ON image_id = id"


def weighted(spark, sf):
    flag = W.vecs(spark, sf).select(F.col("id").alias("image_id"), (F.col("label") != 3).cast("int").alias("ok"))
    return W.images(spark, sf).join(flag, "image_id").select("folder", "pos", "image_id", V.scale(F.col("v"), F.col("ok")).alias("v"))


_MEAN = """
SELECT folder, list(a ORDER BY i) AS m FROM (SELECT folder, i, avg(v[i]) AS a FROM (SELECT folder, v, unnest(range(1, len(v) + 1)) AS i FROM {src}) GROUP BY 1, 2) GROUP BY 1
"""
W.SQL["usable"] = "SELECT * FROM weighted WHERE list_inner_product(v, v) > 0"
W.SQL["pmean"] = _MEAN.format(src="usable")


@query("agg_product_vector", with_views("vecs images weighted usable pmean", """
SELECT f.folder, (SELECT count(*) FROM usable u WHERE u.folder = f.folder) AS n_images,
 coalesce(round(m[1] / sqrt(list_inner_product(m, m)), 6), 0) + 0.0 AS first, coalesce(round(m[64] / sqrt(list_inner_product(m, m)), 6), 0) + 0.0 AS last
FROM (SELECT DISTINCT folder FROM weighted) f LEFT JOIN pmean USING (folder)"""))
def _(spark, sf):
    out = dedup.product_vectors(weighted(spark, sf), "folder")
    return out.select(
        "folder", "n_images", (F.round(F.get("vector", 0), 6) + 0.0).alias("first"), (F.round(F.get("vector", 63), 6) + 0.0).alias("last")
    )


W.SQL["firsts"] = "SELECT folder, v FROM (SELECT label AS folder, v, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM vecs) WHERE n <= 5"
W.SQL["fmean"] = _MEAN.format(src="firsts")


def first_vectors(spark, sf):
    return dedup.first_n_vectors(W.vecs(spark, sf).withColumnRenamed("label", "folder"), "folder", "id")


@query("agg_first_n_vector", with_views("vecs firsts fmean", """
SELECT folder, round(m[1] / sqrt(list_inner_product(m, m)), 6) + 0.0 AS first, round(m[64] / sqrt(list_inner_product(m, m)), 6) + 0.0 AS last FROM fmean"""))
def _(spark, sf):
    return first_vectors(spark, sf).select(
        "folder", (F.round(F.get("vector", 0), 6) + 0.0).alias("first"), (F.round(F.get("vector", 63), 6) + 0.0).alias("last")
    )


# ── hashes ────────────────────────────────────────────────────

_BITS = "bit_count(xor(a.h0, b.h0))::INT + bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) + bit_count(xor(a.h3, b.h3))"
W.SQL["near"] = f"SELECT a.row, b.row AS other, {_BITS} AS distance FROM albums a JOIN albums b ON b.row < a.row WHERE {_BITS} <= 8"
# One row at a time: a row is kept when none of its earlier neighbours was.
W.SQL["nb"] = "SELECT row_number() OVER (ORDER BY row) AS n, row, list(other) AS others FROM near GROUP BY row"
_KEPT = """
WITH RECURSIVE walk(n, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.n + 1, CASE WHEN len(list_filter(nb.others, lambda o: NOT list_contains(w.dropped, o))) > 0 THEN list_append(w.dropped, nb.row) ELSE w.dropped END
  FROM walk w JOIN nb ON nb.n = w.n + 1)
SELECT unnest(dropped) AS row FROM walk WHERE n = (SELECT max(n) FROM walk)
"""
W.SQL["dropped"] = _KEPT


@query("join_phash_neardup", with_views("albums near", "SELECT row, min(other) AS match_row, arg_min(distance, other) AS distance FROM near GROUP BY row"))
def _(spark, sf):
    return phash.first_neighbour(W.albums(spark, sf).select("row", "hash"))


@query("cover_greedy_dedup", with_views("albums near nb dropped", """
SELECT row, min(other) AS match_row FROM near WHERE row IN (SELECT row FROM dropped) AND other NOT IN (SELECT row FROM dropped) GROUP BY row"""))
def _(spark, sf):
    return phash.cover_duplicates(W.albums(spark, sf).select("row", "hash"))


# Albums with titles that repeat, some fetched before (status) and some without a cover.
W.SQL["flagged"] = """
SELECT a.*, concat(p_name, ' ', p_brand) AS full_title, CASE WHEN p_size > 45 THEN 'done' ELSE '' END AS status, p_size % 9 > 0 AS has_cover,
 min(row) OVER (PARTITION BY concat(p_name, ' ', p_brand)) AS first_row FROM albums a JOIN part ON p_partkey = row"""
W.SQL["open_albums"] = "SELECT row, h0, h1, h2, h3 FROM flagged WHERE row = first_row AND status = '' AND has_cover"


@query("album_dedup", with_views(
    "albums flagged open_albums",
    """
SELECT row, CASE WHEN row <> first_row THEN 'title' WHEN match_row IS NOT NULL THEN 'cover' ELSE '' END AS reason,
 CASE WHEN row <> first_row THEN first_row ELSE coalesce(match_row, -1) END AS match_row FROM flagged LEFT JOIN hit USING (row)""",
    near=f"SELECT a.row, b.row AS other FROM open_albums a JOIN open_albums b ON b.row < a.row WHERE {_BITS} <= 8",
    nb=W.SQL["nb"],
    dropped=_KEPT,
    hit="SELECT row, min(other) AS match_row FROM near WHERE row IN (SELECT row FROM dropped) AND other NOT IN (SELECT row FROM dropped) GROUP BY row",
))
def _(spark, sf):
    p = W.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.when(F.col("p_size") > 45, "done").alias("status"), (F.col("p_size") % 9 > 0).alias("has_cover"),
    )
    a = W.albums(spark, sf).select("row", "hash").join(p, "row").withColumn("hash", F.when(F.col("has_cover"), F.col("hash")))
    out = phash.album_duplicates(a.drop("has_cover"))
    return out.select("row", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("match_row", F.lit(-1)).alias("match_row"))


# ── ordered product scan ──────────────────────────────────────

# Here the registry is the image means of the folders, so that copies inside the batch decide.
_SIM = "round(list_inner_product(a.v, b.v), 9)"


@query("dedup_batch_scan", with_views(
    "vecs images cand",
    """
SELECT qid, CASE WHEN s >= 0.92 THEN 'duplicate' WHEN s >= 0.85 THEN 'review' ELSE 'new' END AS status, round(s, 6) AS best_sim FROM best""",
    fm=_MEAN.format(src="images"),
    items="SELECT folder AS id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS v FROM fm",
    reg=f"SELECT a.qid, max({_SIM}) AS s FROM cand a CROSS JOIN items b GROUP BY 1",
    waiting="SELECT c.qid, c.v FROM cand c JOIN reg USING (qid) WHERE s < 0.85",
    sims=f"SELECT a.qid AS row, b.qid AS other, {_SIM} AS s FROM cand a JOIN waiting b ON b.qid < a.qid",
    pairs="SELECT row, other FROM sims JOIN waiting ON qid = row WHERE s >= 0.85",
    nb="SELECT row_number() OVER (ORDER BY row) AS n, row, list(other) AS others FROM pairs GROUP BY row",
    dropped=_KEPT,
    batch="SELECT row AS qid, max(s) AS s FROM sims WHERE other NOT IN (SELECT row FROM dropped) GROUP BY 1",
    best="SELECT qid, greatest(reg.s, coalesce(batch.s, -2)) AS s FROM reg LEFT JOIN batch USING (qid)",
))
def _(spark, sf):
    means = dedup.product_vectors(W.images(spark, sf), "folder").select(F.col("folder").alias("id"), F.col("vector").alias("v"))
    out = dedup.batch_scan(W.cand(spark, sf), means)
    return out.select("qid", "status", F.round("best_sim", 6).alias("best_sim"))


@query("dedup_scan_folder", with_views("vecs images weighted usable pmean", """
SELECT p_partkey AS row, CASE WHEN NOT EXISTS (SELECT 1 FROM weighted w WHERE w.folder = p_partkey) THEN 'no images'
 WHEN NOT EXISTS (SELECT 1 FROM usable u WHERE u.folder = p_partkey) THEN 'no usable image' ELSE '' END AS error,
 CASE WHEN s IS NULL OR s < 0.85 THEN 'new' WHEN s < 0.92 THEN 'review' ELSE 'duplicate' END AS status, coalesce(round(s, 6), -1) AS best_sim
FROM part LEFT JOIN (SELECT folder, max(round(list_inner_product(m, v) / sqrt(list_inner_product(m, m)), 9)) AS s FROM pmean CROSS JOIN (SELECT vecs.v FROM vecs) r GROUP BY 1) ON folder = p_partkey"""))
def _(spark, sf):
    products = W.table(spark, sf, "part").select(F.col("p_partkey").alias("folder"))
    vecs = dedup.product_vectors(weighted(spark, sf), "folder")
    usable = vecs.where("n_images > 0").select(F.col("folder").alias("qid"), F.col("vector").alias("v"))
    decided = dedup.decide(usable.drop("v"), similarity.top_k(usable, registry_items(spark, sf))).withColumnRenamed("qid", "folder")
    out = dedup.scan_folders(products, vecs, decided, "folder")
    return out.select(F.col("folder").alias("row"), F.coalesce("error", F.lit("")).alias("error"), "status", F.coalesce(F.round("best_sim", 6), F.lit(-1.0)).alias("best_sim"))


# ── approximate search and stored cells ───────────────────────

@query("join_vector_topk_ivf")
def _(spark, sf):
    stock = registry_items(spark, sf)
    tree = cell_tree.train(stock)
    found = cell_tree.search(W.cand(spark, sf), cell_tree.place(stock, tree), tree)
    return found.select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query("join_vector_topk_pq")
def _(spark, sf):
    stock = registry_items(spark, sf)
    n, dim = stock.count(), len(stock.select("v").first()["v"])
    tree = cell_tree.train(stock, cells.cell_count(n, quantised=True))
    rest = cut(cell_tree.residuals(cell_tree.place(stock, tree), tree))
    book = cells.train_codebooks(rest, *cells.pq_shape(dim, n))
    found = cell_tree.pq_search(W.cand(spark, sf), cells.encode(rest, book), tree, book, items=stock)
    return found.select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query("vector_cells_write", "SELECT vec_id AS id, 1::BIGINT AS copies, true AS in_nearest FROM embeddings")
def _(spark, sf):
    stock = registry_items(spark, sf)
    path = scratch_path(spark, "cells")
    cells.write(stock, cells.train_cells(stock), path, "2024-01-01")
    written = spark.read.parquet(f"{path}/vectors").select("id", "cell", "v")
    # Every stored row against every centroid, block by block, and against its own.
    centroids = spark.read.parquet(f"{path}/centroids")
    top = similarity.top_k(written.select(F.col("id").alias("qid"), "v"), centroids.select(F.col("cell").cast("long").alias("id"), "v"), 1)
    own = written.join(centroids.withColumnRenamed("v", "w"), "cell").groupBy("id").agg(F.max(V.dot(F.col("v"), F.col("w"))).alias("own"), F.count(F.lit(1)).alias("copies"))
    return own.join(top.select(F.col("qid").alias("id"), F.col("sim").alias("top")), "id").select("id", "copies", (F.col("own") >= F.col("top") - 1e-8).alias("in_nearest"))


@query("vector_cells_read", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings")
def _(spark, sf):
    stock = registry_items(spark, sf)
    path = scratch_path(spark, "cells")
    centres = cells.train_cells(stock)
    cells.write(stock, centres, path, "2024-01-01")
    stored, _, _ = cells.read(spark, path, centres.shape[1])
    return stored.select("id", (F.round(F.get("v", 0).cast("double"), 6) + 0.0).alias("first"))


# Three deliveries that together are the whole table: 12, 1 and 3 of every 16 rows. The
# second adds too little to train anew, the third enough.
@query("vector_cells_append", """
SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first, (SELECT count(*) FROM embeddings) AS trained, false AS anew_second, true AS anew_third FROM embeddings""")
def _(spark, sf):
    stock = registry_items(spark, sf)
    share = F.col("id") % 16
    path = scratch_path(spark, "growing")
    first = stock.where(share < 12)
    centres = cells.train_cells(first)
    dim = centres.shape[1]
    cells.write(first, centres, path, "2024-01-01")
    path, second = cells.extend(path, stock.where(share == 12), dim, "2024-02-01")
    path, third = cells.extend(path, stock.where(share > 12), dim, "2024-03-01")
    stored, _, meta = cells.read(spark, path, dim)
    return stored.select(
        "id", (F.round(F.get("v", 0).cast("double"), 6) + 0.0).alias("first"), F.lit(meta["trained"]).cast("long").alias("trained"),
        F.lit(second).alias("anew_second"), F.lit(third).alias("anew_third"),
    )


# Cells here are the labels; three rows of ten came after training.
@query("vector_cells_drift", with_views("vecs", """
SELECT coalesce(label, -1) AS cell, count(*) FILTER (id % 10 < 7) AS trained, count(*) FILTER (id % 10 >= 7) AS added,
 count(*) FILTER (id % 10 < 7) > 0 AND count(*) FILTER (id % 10 >= 7) > count(*) FILTER (id % 10 < 7) * 0.2 AS retrain FROM vecs GROUP BY ROLLUP (label)"""))
def _(spark, sf):
    aged = W.vecs(spark, sf).select("id", F.col("label").alias("cell"), F.when(F.col("id") % 10 < 7, "2024-01-01").otherwise("2024-02-01").alias("added_at"))
    return cells.drift(aged, "added_at", "2024-01-01").withColumn("cell", F.coalesce("cell", F.lit(-1)))


@query("vector_cells_remove", with_views("vecs", "SELECT id, label AS cell FROM vecs WHERE id NOT IN (SELECT s_suppkey FROM supplier)"))
def _(spark, sf):
    path = scratch_path(spark, "removal")
    W.vecs(spark, sf).select("id", "v", F.col("label").alias("cell")).write.partitionBy("cell").parquet(f"{path}/vectors")
    gone = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    cells.remove_stored(path, gone)
    return spark.read.parquet(f"{path}/vectors").select("id", "cell")


# ── labels and names ──────────────────────────────────────────

W.SQL["sims"] = """
SELECT x.id, kind, name, pos, round(list_inner_product(x.v, l.v), 9) AS s FROM vecs x CROSS JOIN labelvecs l"""


@query("zero_shot_argmax", with_views("vecs labelvecs sims", """
SELECT id, name AS category, round(s, 6) AS sim FROM sims WHERE kind = 'category' QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) = 1"""))
def _(spark, sf):
    labels = zero_shot.label_table(W.labelvecs(spark, sf))
    return zero_shot.categories(W.vecs(spark, sf), labels, "id", "v").select("id", "category", F.round("sim", 6).alias("sim"))


@query("zero_shot_name", with_views("vecs labelvecs sims", """
SELECT id, CASE WHEN count(*) FILTER (ok) = 0 THEN '未命名' ELSE string_agg(name, ' ' ORDER BY kind) FILTER (ok) END AS name FROM (
 SELECT id, kind, name, s > CASE kind WHEN 'category' THEN 0.2 ELSE 0.15 END AS ok FROM sims QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY s DESC, pos) = 1) GROUP BY id"""))
def _(spark, sf):
    labels = zero_shot.label_table(W.labelvecs(spark, sf))
    return zero_shot.names(W.vecs(spark, sf), labels, "id", "v").select("id", "name")


@query("title_batch", with_views(
    "vecs labelvecs images",
    """
SELECT p_partkey AS row, CASE WHEN name IS NULL THEN '(空文件夹)' ELSE concat(['新款', '爆款', '热卖', '推荐'][(p_partkey * 7919 + 104729) % 4 + 1],
  ['潮流', '休闲', '时尚', '经典', '街头', '复古'][(p_partkey * 7919 + 2 * 104729) % 6 + 1], name,
  ['百搭', '时尚单品', '穿搭必备', '好物'][(p_partkey * 7919 + 3 * 104729) % 4 + 1]) END AS title,
 CASE WHEN name IS NULL THEN 0 ELSE 25.5 END AS price, CASE WHEN name IS NULL THEN 0 ELSE 5 END AS n_main FROM part LEFT JOIN best ON folder = p_partkey""",
    fm=_MEAN.format(src="images"),
    best="""SELECT folder, name FROM fm CROSS JOIN labelvecs l WHERE kind = 'category'
 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY round(list_inner_product(m, l.v) / sqrt(list_inner_product(m, m)), 9) DESC, pos) = 1""",
))
def _(spark, sf):
    labels = zero_shot.label_table(W.labelvecs(spark, sf))
    img = W.images(spark, sf).withColumn("path", F.format_string("%03d.jpg", "pos"))
    folders = W.table(spark, sf, "part").select(F.col("p_partkey").alias("row"), F.col("p_partkey").alias("folder"))
    out = variants.listings(folders, img.select("folder", "path"), img.select("folder", "path", "v"), labels, 25.5)
    return out.select("row", "title", "price", F.size("main_images").alias("n_main"))


