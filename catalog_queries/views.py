"""Inputs of the queries, derived from the shared tables, in Spark and in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import vectors as V

HOST = "shop.example.com"
BASE = f"https://{HOST}/photos/demo"

SQL: dict[str, str] = {}


def with_views(names: str, body: str, **local: str) -> str:
    """``body`` preceded by the named views and then the local ones, in order."""
    found = [(n, SQL[n]) for n in names.split()] + list(local.items())
    parts = [f"{n} AS MATERIALIZED ({text})" for n, text in found]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The test tables are single files of one row group; hand their rows to all cores, also to those that have yet to join."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


# Vectors: every row of ``embeddings``.
SQL["vecs"] = "SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings"


def vecs(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


# Candidates: two blends of every vector with the next one; with weight 0 an exact copy.
SQL["cand"] = """
SELECT qid, CASE WHEN n > 0 THEN list_transform(raw, lambda t: t / n) ELSE raw END AS v FROM (
  SELECT qid, raw, sqrt(list_inner_product(raw, raw)) AS n FROM (
    SELECT 2 * a.id + c.copy AS qid,
      list_transform(list_zip(a.v, b.v), lambda p: p[1] + [0.0::DOUBLE, 0.3, 0.55, 1.0][((a.id + c.copy) % 4 + 1)::INT] * p[2]) AS raw
    FROM vecs a JOIN vecs b ON b.id = (a.id + 1) % (SELECT count(*) FROM vecs)
    CROSS JOIN (VALUES (0), (1)) c(copy)))
"""


def cand(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("v"))
    n = e.count()
    nxt = e.select(F.pmod(F.col("id") - 1, F.lit(n)).alias("id"), F.col("v").alias("w"))
    copies = e.join(nxt, "id").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    weight = F.element_at(
        F.array(*[F.lit(x) for x in (0.0, 0.3, 0.55, 1.0)]), ((F.col("id") + F.col("copy")) % 4 + 1).cast("int")
    )
    mixed = F.zip_with("v", F.transform("w", lambda x: x * weight), lambda a, b: a + b)
    return copies.select((F.col("id") * 2 + F.col("copy")).alias("qid"), V.l2_normalize(mixed).alias("v"))


# Images: vectors in folders of five.
SQL["images"] = "SELECT id AS image_id, id // 5 AS folder, (id % 5)::INT AS pos, v FROM vecs"


def images(spark, sf):
    return vecs(spark, sf).select(
        F.col("id").alias("image_id"), F.floor(F.col("id") / 5).alias("folder"), (F.col("id") % 5).cast("int").alias("pos"), "v"
    )


# Products: one per part.
SQL["products"] = """
SELECT p_partkey AS id, p_name AS name, p_brand AS store, concat('f', p_partkey) AS folder,
  p_size AS image_count, p_retailprice AS price FROM part
"""


def products(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("store"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("folder"),
        F.col("p_size").alias("image_count"), F.col("p_retailprice").alias("price"),
    )


# Incoming folders: one per order, so customers repeat and only some are registered.
SQL["incoming"] = """
SELECT o_orderkey AS row, concat('f', 2 * o_custkey) AS folder, o_orderpriority AS name,
  'new' AS store, 1 AS image_count, o_totalprice AS price FROM orders
"""


def incoming(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row"), F.concat(F.lit("f"), (F.col("o_custkey") * 2).cast("string")).alias("folder"),
        F.col("o_orderpriority").alias("name"), F.lit("new").alias("store"), F.lit(1).alias("image_count"),
        F.col("o_totalprice").alias("price"),
    )


# Albums: one per part, in row order, with a 256-bit cover hash. Four neighbouring albums
# have hashes 0, 4, 8 and 12 flipped bits away from a common one.
SQL["albums"] = """
SELECT p_partkey AS row, p_partkey::VARCHAR AS album_id, p_name AS title,
  ((g * 48271 + 11) % 2147483647 << 32) | ((g * 69621 + 5) % 2147483647) AS h0,
  ((g * 16807 + 77) % 2147483647 << 32) | xor((g * 39373 + 3) % 2147483647, (1 << (4 * (p_partkey % 4))::INT) - 1) AS h1,
  ((g * 40692 + 13) % 2147483647 << 32) | ((g * 40014 + 9) % 2147483647) AS h2,
  ((g * 30269 + 21) % 2147483647 << 32) | ((g * 30307 + 1) % 2147483647) AS h3
FROM (SELECT *, (p_partkey // 4)::BIGINT * 104729 + 17 AS g FROM part)
"""


def albums(spark, sf):
    g = F.floor(F.col("p_partkey") / 4) * 104729 + 17
    m = F.lit(2147483647)

    def word(a, b, c, d, flip=None):
        low = (g * c + d) % m
        if flip is not None:
            low = low.bitwiseXOR(flip)
        return F.shiftleft((g * a + b) % m, 32).bitwiseOR(low)

    flips = F.element_at(F.array(*[F.lit((1 << (4 * i)) - 1).cast("bigint") for i in range(4)]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row"), F.col("p_partkey").cast("string").alias("album_id"), F.col("p_name").alias("title"),
        F.array(word(48271, 11, 69621, 5), word(16807, 77, 39373, 3, flips), word(40692, 13, 40014, 9), word(30269, 21, 30307, 1)).alias("hash"),
    )


# Files: up to six per part, extensions and contents in turn.
SQL["files"] = """
SELECT folder, row, n, concat(folder, '/', lpad(n::VARCHAR, 2, '0'), ext) AS path, ext,
  p_size * 100 + n AS length, head FROM (
  SELECT concat('f', p_partkey) AS folder, p_partkey * 8 + n AS row, n, p_size,
    ['.jpg', '.JPEG', '.png', '.webp', '.bmp', '.txt'][(p_partkey + n) % 6 + 1] AS ext,
    CASE WHEN (p_partkey + n) % 9 = 0 THEN '3C68746D6C'
      ELSE ['FFD8FFE000104A464946', 'FFD8FFE1001845786966', '89504E470D0A1A0A', '52494646AABBCCDD57454250', '424D3600', '7465787420'][(p_partkey + n) % 6 + 1] END AS head
  FROM (SELECT p_partkey, p_size, unnest(range(1, p_partkey % 7 + 1)) AS n FROM part))
"""

_EXT = [".jpg", ".JPEG", ".png", ".webp", ".bmp", ".txt"]
_HEAD = ["FFD8FFE000104A464946", "FFD8FFE1001845786966", "89504E470D0A1A0A", "52494646AABBCCDD57454250", "424D3600", "7465787420"]


def files(spark, sf):
    slot = ((F.col("p_partkey") + F.col("n")) % 6 + 1).cast("int")
    head = F.when((F.col("p_partkey") + F.col("n")) % 9 == 0, F.lit("3C68746D6C")).otherwise(
        F.element_at(F.array(*[F.lit(h) for h in _HEAD]), slot)
    )
    return (
        table(spark, sf, "part")
        .select("p_partkey", "p_size", F.explode(F.expr("slice(sequence(1L, 7L), 1, int(p_partkey % 7))")).alias("n"))
        .withColumn("folder", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
        .withColumn("ext", F.element_at(F.array(*[F.lit(e) for e in _EXT]), slot))
        .select(
            "folder", (F.col("p_partkey") * 8 + F.col("n")).alias("row"), "n",
            F.concat("folder", F.lit("/"), F.lpad(F.col("n").cast("string"), 2, "0"), "ext").alias("path"),
            "ext", (F.col("p_size") * 100 + F.col("n")).alias("length"), F.unhex(head).alias("content"),
        )
    )


# Download results: every event is one image of an album of its user.
SQL["downloads"] = """
SELECT event_id, concat(user_id, ':', event_id % 5) AS key, concat(event_id, '.jpeg') AS file, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS outcome,
  props AS error FROM events
"""


def downloads(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string")).alias("key"),
        F.concat(F.col("event_id").cast("string"), F.lit(".jpeg")).alias("file"),
        "ts",
        F.when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("success").alias("outcome"),
        F.col("props").alias("error"),
    )


# Download log: the downloads added up per album.
SQL["dlog"] = """
SELECT key, count(*) AS image_count, count(*) FILTER (outcome <> 'failed') AS downloaded,
  CASE WHEN count(*) FILTER (outcome = 'failed') = 0 THEN 'done' ELSE 'partial' END AS status,
  concat('dir', split_part(key, ':', 1)) AS folder, max(ts) AS updated_at
FROM downloads GROUP BY key
"""


def dlog(spark, sf):
    from vitrine.operators import state

    d = downloads(spark, sf)
    s = state.download_status(state.download_summary(d).where(F.col("key").isNotNull()))
    last = d.groupBy("key").agg(F.max("ts").alias("updated_at"))
    return s.join(last, "key").select(
        "key", F.col("total").alias("image_count"), "downloaded", "status",
        F.concat(F.lit("dir"), F.substring_index("key", ":", 1)).alias("folder"), "updated_at",
    )


# Shop albums: one per order of a customer, most of them not in the log.
SQL["shop"] = """
SELECT o_orderkey AS row, concat(o_custkey, ':', o_orderkey % 5) AS key, o_orderpriority AS title,
  floor(o_totalprice / 10000)::INT AS image_count FROM orders
"""


def shop(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row"),
        F.concat_ws(":", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 5).cast("string")).alias("key"),
        F.col("o_orderpriority").alias("title"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("image_count"),
    )


# Feature store: two namespaces; entries 0 to 120 days old at the moment NOW.
NOW = "2024-06-01 00:00:00"
SQL["store"] = f"""
SELECT concat('img/', id) AS key, ns AS namespace, 1700000000.5 + id AS mtime,
  TIMESTAMP '{NOW}' - to_seconds((id % 121) * 86400 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) AS written_at, v AS feature
FROM vecs CROSS JOIN (VALUES (''), ('combined')) t(ns)
"""


def store(spark, sf):
    age = (F.col("id") % 121) * 86400 + F.when(F.col("id") % 2 == 0, 0).otherwise(1)
    now_s = F.unix_seconds(F.lit(NOW).cast("timestamp"))
    return vecs(spark, sf).withColumn("namespace", F.explode(F.array(F.lit(""), F.lit("combined")))).select(
        F.concat(F.lit("img/"), F.col("id").cast("string")).alias("key"), "namespace",
        (F.lit(1700000000.5) + F.col("id")).alias("mtime"),
        F.timestamp_seconds(now_s - age).alias("written_at"), F.col("v").alias("feature"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


# Split history: the newest order of every customer; later keys win a shared date.
SQL["history"] = """
SELECT o_orderkey AS history_id, concat('c/', o_custkey) AS folder, o_orderdate AS split_time,
  1 + o_orderkey % 4 AS group_count, floor(o_totalprice / 10000)::INT AS image_count, o_orderstatus = 'F' AS has_features
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""


def history(spark, sf):
    from vitrine.operators.ordering import latest_per_key

    o = latest_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return o.select(
        F.col("o_orderkey").alias("history_id"), F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("folder"),
        F.col("o_orderdate").alias("split_time"), (1 + F.col("o_orderkey") % 4).alias("group_count"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("image_count"),
        (F.col("o_orderstatus") == "F").alias("has_features"),
    )


# Groups and images of the history: one image per order line, dealt to the groups.
SQL["hgroups"] = """
SELECT history_id, unnest(range(0, group_count)) AS group_id, concat('g', unnest(range(0, group_count))) AS group_name FROM history
"""
SQL["himages"] = """
SELECT l_orderkey AS history_id, l_linenumber % group_count AS group_id, concat(folder, '/', l_partkey, '-', l_suppkey, '-', l_linenumber) AS file_path
FROM lineitem JOIN history ON history_id = l_orderkey
"""


def hgroups(spark, sf):
    return history(spark, sf).select("history_id", F.explode(F.expr("sequence(0L, group_count - 1)")).alias("group_id")).withColumn(
        "group_name", F.concat(F.lit("g"), F.col("group_id").cast("string"))
    )


def himages(spark, sf):
    h = history(spark, sf).select("history_id", "group_count", "folder")
    return table(spark, sf, "lineitem").join(h, F.col("l_orderkey") == F.col("history_id")).select(
        "history_id", (F.col("l_linenumber") % F.col("group_count")).alias("group_id"),
        F.concat("folder", F.lit("/"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")])).alias("file_path"),
    )


# Upload marks: folders of the parts that were ever returned.
SQL["marks"] = """
SELECT p_brand AS parent_dir, concat('f', p_partkey) AS folder, max(l_shipdate) AS marked_at
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1, 2
"""


def marks(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")
    return (
        li.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("p_brand").alias("parent_dir"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("folder"))
        .agg(F.max("l_shipdate").alias("marked_at"))
    )


# Listings: one per part; some titles are blank and some prices are no numbers.
SQL["listings"] = """
SELECT p_partkey AS row, p_brand AS parent_dir, concat('f', p_partkey) AS folder,
  CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS title,
  CASE WHEN p_partkey % 17 = 0 THEN 'abc' WHEN p_partkey % 19 = 0 THEN '-1' ELSE p_retailprice::VARCHAR END AS price_text,
  p_retailprice AS price, p_size > 10 AS selected, p_size AS n_images FROM part
"""


def listings(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("row"), F.col("p_brand").alias("parent_dir"), F.concat(F.lit("f"), k.cast("string")).alias("folder"),
        F.when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 17 == 0, "abc").when(k % 19 == 0, "-1").otherwise(F.col("p_retailprice").cast("string")).alias("price_text"),
        F.col("p_retailprice").alias("price"), (F.col("p_size") > 10).alias("selected"), F.col("p_size").alias("n_images"),
    )


# Label vectors: mean vector of every label, once per kind.
SQL["labelvecs"] = """
SELECT kind, concat(kind, '-', label) AS name, label AS pos, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS v FROM (
  SELECT label, list(a ORDER BY i) AS m FROM (
    SELECT label, i, avg(v[i]) AS a FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vecs) GROUP BY label, i)
  GROUP BY label) CROSS JOIN (VALUES ('category'), ('colour'), ('style')) k(kind)
"""


def labelvecs(spark, sf):
    from vitrine.operators.dedup import mean_vector

    kinds = F.explode(F.array(F.lit("category"), F.lit("colour"), F.lit("style")))
    return mean_vector(vecs(spark, sf), "label").select(
        kinds.alias("kind"), F.col("label").alias("pos"), V.l2_normalize(F.col("mean")).alias("v")
    ).withColumn("label", F.concat_ws("-", "kind", F.col("pos").cast("string")))


# Rasters: one small picture per part; some have a white frame, some are white all over,
# and those of size 13 are corrupt.
SQL["rasters"] = """
SELECT p_partkey AS image_id, p_brand AS folder, p_size, 12 + p_size % 13 AS width, 12 + (p_size * 3) % 11 AS height FROM part
"""
SQL["px"] = """
SELECT image_id, width, height, x, y, CASE WHEN white THEN 255 ELSE r END AS r, CASE WHEN white THEN 255 ELSE g END AS g, CASE WHEN white THEN 255 ELSE b END AS b FROM (
 SELECT image_id, width, height, x, y, p_size = 50 OR (p_size % 2 = 0 AND (x < 4 OR y < 4 OR x >= width - 4 OR y >= height - 4)) AS white,
  (image_id * 31 + x * 7 + y * 13) % 256 AS r, (image_id * 17 + x * 3 + y * 5) % 256 AS g, (image_id * 11 + x * x + y) % 256 AS b
 FROM (SELECT *, unnest(range(0, height)) AS y FROM (SELECT *, unnest(range(0, width)) AS x FROM rasters WHERE p_size <> 13)))
"""


def rasters(spark, sf):
    """Rows as the image source gives them: (image_id, folder, height, width, nChannels, data)."""
    import numpy as np
    import pandas as pd

    def paint(batches):
        for t in batches:
            data = [b""] * len(t)
            # Pictures of one size have one shape and frame; bytes wrap around as the remainders do.
            for size, rows in t.reset_index(drop=True).groupby("p_size").indices.items():
                w, h = int(t["width"].iloc[rows[0]]), int(t["height"].iloc[rows[0]])
                y, x = np.mgrid[0:h, 0:w]
                pattern = np.stack([x * x + y, x * 3 + y * 5, x * 7 + y * 13], axis=-1).astype(np.uint8)
                frame = (x < 4) | (y < 4) | (x >= w - 4) | (y >= h - 4)
                white = np.ones_like(frame) if size == 50 else frame if size % 2 == 0 else np.zeros_like(frame)
                keys = t["image_id"].to_numpy()[rows]
                for low in range(0, 0 if size == 13 else len(rows), 1024):
                    k = keys[low : low + 1024, None]
                    px = (k * np.array([11, 17, 31])).astype(np.uint8)[:, None, None, :] + pattern
                    px[:, white] = 255
                    for row, picture in zip(rows[low : low + 1024], px.reshape(len(px), -1)):
                        data[row] = picture.tobytes()
            bad = t["p_size"] == 13
            yield pd.DataFrame({
                "image_id": t["image_id"], "folder": t["folder"], "height": t["height"].where(~bad, -1), "width": t["width"].where(~bad, -1),
                "nChannels": np.where(bad, -1, 3), "data": data,
            })

    size = F.col("p_size")
    base = table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("folder"), "p_size",
        (12 + size % 13).alias("width"), (12 + (size * 3) % 11).alias("height"),
    )
    return spread(base).mapInPandas(paint, "image_id long, folder string, height int, width int, nChannels int, data binary")


def pixel_rows(spark, sf):
    """The same pictures, one row per pixel."""
    size = F.col("p_size")
    p = spread(table(spark, sf, "part")).where("p_size <> 13").select(
        F.col("p_partkey").alias("image_id"), "p_size", (12 + size % 13).alias("width"), (12 + (size * 3) % 11).alias("height")
    )
    p = p.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    k, x, y = F.col("image_id"), F.col("x"), F.col("y")
    frame = (x < 4) | (y < 4) | (x >= F.col("width") - 4) | (y >= F.col("height") - 4)
    white = (size == 50) | ((size % 2 == 0) & frame)
    tone = lambda c: F.when(white, F.lit(255)).otherwise((c % 256).cast("int"))
    return p.select(
        "image_id", tone(k * 31 + x * 7 + y * 13).alias("r"), tone(k * 17 + x * 3 + y * 5).alias("g"), tone(k * 11 + x * x + y).alias("b")
    )
