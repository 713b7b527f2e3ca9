"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import settings as S
from vitrine.functions import labels as L
from vitrine.functions import text as T
from vitrine.functions import urls as U
from vitrine.functions import vectors as V
from vitrine.operators import html, listing

from . import views as W
from .registry import query
from .views import HOST, table, with_views


@query("fn_username", f"""
SELECT c_custkey, coalesce(nullif(regexp_extract(url, '{HOST}/photos/([^/]+)', 1), ''),
  nullif(regexp_extract(url, '//([^.]+)\\.{HOST}', 1), ''), 'rejected') AS username
FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN concat('https://{HOST}/photos/', lower(c_mktsegment), c_custkey, '/albums?tab=1')
  WHEN 1 THEN concat('https://', lower(c_mktsegment), '.{HOST}/albums') ELSE concat('https://other.example.org/', c_custkey) END AS url FROM customer)""")
def _(spark, sf):
    kind, seg = F.col("c_nationkey") % 3, F.lower("c_mktsegment")
    key = F.col("c_custkey").cast("string")
    url = (
        F.when(kind == 0, F.concat(F.lit(f"https://{HOST}/photos/"), seg, key, F.lit("/albums?tab=1")))
        .when(kind == 1, F.concat(F.lit("https://"), seg, F.lit(f".{HOST}/albums")))
        .otherwise(F.concat(F.lit("https://other.example.org/"), key))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", F.coalesce(U.username(url, HOST), F.lit("rejected")).alias("username")
    )


_LINKS = r"""
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS page_title,
  unnest(range(0, len(a))) AS pos, unnest(h) AS href, unnest(a) AS inner_html
FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1) AS h,
  regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS a FROM pages)
"""
W.SQL["links"] = _LINKS


@query("html_links", with_views("links", """
SELECT page_id, page_title, pos::INT AS pos, href, trim(regexp_replace(inner_html, '<[^>]*>', '', 'g')) AS text FROM links"""))
def _(spark, sf):
    return html.links(table(spark, sf, "pages"))


@query("fn_resolve_url", with_views("links", f"""
SELECT page_id, pos::INT AS pos, concat('https://{HOST}', href) AS absolute, concat('{W.BASE}/', substr(href, 2)) AS relative,
  concat('https:', '/', href) AS cover FROM links"""))
def _(spark, sf):
    return html.links(table(spark, sf, "pages")).select(
        "page_id",
        "pos",
        U.resolve_url(F.lit(W.BASE), F.col("href")).alias("absolute"),
        U.resolve_url(F.lit(W.BASE), F.substring(F.col("href"), F.lit(2), F.length("href"))).alias("relative"),
        U.cover_url(F.concat(F.lit("/"), F.col("href"))).alias("cover"),
    )


@query("fn_resize_url", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, regexp_replace(concat('https://h/', l_partkey, '/',
  ['square','small','medium','big','large','original','full','other'][l_linenumber % 8 + 1], '.jpeg?p=/small.x'),
  '/(square|small|medium|big|large|original|full)\\.', '/big.', 'g') AS url FROM lineitem""".replace("\\\\", "\\"))
def _(spark, sf):
    sizes = F.array(*[F.lit(s) for s in (*S.URL_SIZES, "other")])
    url = F.concat(
        F.lit("https://h/"), F.col("l_partkey").cast("string"), F.lit("/"),
        F.element_at(sizes, F.col("l_linenumber") % 8 + 1), F.lit(".jpeg?p=/small.x"),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", U.resize_url(url).alias("url")
    )


@query("fn_url_ext", r"""
SELECT page_id, CASE WHEN e <> '' AND length(e) <= 5 THEN e ELSE '.jpeg' END AS ext
FROM (SELECT page_id, regexp_extract(split_part(url, '?', 1), '(\.[^.]*)$', 1) AS e FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_extension(F.col("url")).alias("ext"))


_SP = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"
_RES = ", ".join(f"'{n}'" for n in S.RESERVED_NAMES)


@query("fn_sanitize_name", rf"""
SELECT doc_id, CASE WHEN e = '' THEN 'untitled' ELSE e END AS name FROM (
 SELECT doc_id, regexp_replace(substring(CASE WHEN upper(split_part(d, '.', 1)) IN ({_RES}) THEN concat('_', d) ELSE d END, 1, 200), '[ _.]+$', '') AS e FROM (
  SELECT doc_id, CASE WHEN c = '' THEN 'untitled' ELSE c END AS d FROM (
   SELECT doc_id, regexp_replace(regexp_replace(b, '^[ _.]+', ''), '[ _.]+$', '') AS c FROM (
    SELECT doc_id, regexp_replace(regexp_replace(a, '[\\/:*?"<>|]', '_', 'g'), '[_ ]{{2,}}', '_', 'g') AS b FROM (
     SELECT doc_id, regexp_replace(regexp_replace(text, '^{_SP}+', ''), '{_SP}+$', '') AS a FROM documents)))))""")
def _(spark, sf):
    return W.spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.sanitize_name(F.col("text")).alias("name"))


@query("fn_parse_count", """
SELECT event_id, coalesce(try_cast(trim(CASE event_type WHEN 'view' THEN concat(' ', k, ' ') WHEN 'click' THEN concat(k, 'x') WHEN 'error' THEN '' ELSE k END) AS BIGINT), 0) AS n
FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)""")
def _(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit(" "), k, F.lit(" ")))
        .when(kind == "click", F.concat(k, F.lit("x")))
        .when(kind == "error", F.lit(""))
        .otherwise(k)
    )
    return table(spark, sf, "events").select("event_id", T.parse_count(text).alias("n"))


@query("fn_title_fallback", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE p_partkey::VARCHAR END AS title FROM part""")
def _(spark, sf):
    kind = F.col("p_size") % 3
    attr = F.when(kind == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ")
    inner = F.when(kind < 2, F.concat(F.col("p_type"), F.lit("\n")))
    return table(spark, sf, "part").select(
        "p_partkey", T.title_or(attr, inner, F.col("p_partkey").cast("string")).alias("title")
    )


@query("fn_category_name", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE concat(p_name, ' (x)') END AS name,
  CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS album_count FROM part""")
def _(spark, sf):
    text = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(
        F.concat("p_name", F.lit(" (x)"))
    )
    return table(spark, sf, "part").select("p_partkey", U.category_name(text).alias("name"), U.category_count(text).alias("album_count"))


_CATEGORY_HREF = {0: "/photos/u/categories/{k}?referrercate=9", 1: "/albums?tab=gallery&referrercate={k}", 2: "/albums?cate={k}#x", 3: "/albums?page=2"}


def category_href(key):
    kind = F.col("p_size") % 4
    out = F.lit("")
    for n, shape in _CATEGORY_HREF.items():
        a, _, b = shape.partition("{k}")
        out = F.when(kind == n, F.concat(F.lit(a), key if "{k}" in shape else F.lit(""), F.lit(b))).otherwise(out)
    return out


@query("fn_category_id", "SELECT p_partkey, p_partkey::VARCHAR AS category_id FROM part WHERE p_size % 4 < 3")
def _(spark, sf):
    found = U.category_id(category_href(F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", found.alias("category_id")).where("category_id IS NOT NULL")


@query("fn_image_filename", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat(lpad((l_quantity::INT * l_linenumber)::VARCHAR, greatest(2, length((l_quantity::INT * l_linenumber)::VARCHAR))::INT, '0'), '.webp') AS file FROM lineitem""")
def _(spark, sf):
    pos = F.col("l_quantity").cast("int") * F.col("l_linenumber") - 1
    ext = U.url_extension(F.lit("https://h/a/big.webp?x=1.jpg"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.image_filename(pos, ext).alias("file")
    )


@query("fn_valid_image", with_views("files", """
SELECT path, (starts_with(head, 'FFD8FF') OR starts_with(head, '89504E470D0A') OR starts_with(head, '52494646')
  OR starts_with(head, '474946383761') OR starts_with(head, '474946383961') OR starts_with(head, '424D')) AND length(head) >= 8 AS valid FROM files"""))
def _(spark, sf):
    return W.files(spark, sf).select("path", T.is_image_content(F.col("content")).alias("valid"))


@query("fn_safe_path", """
SELECT p_partkey, NOT starts_with(any_value(name), '/') AND min(depth) >= 0 AS accepted FROM (
 SELECT p_partkey, name, sum(CASE part WHEN '..' THEN -1 WHEN '.' THEN 0 WHEN '' THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth FROM (
  SELECT p_partkey, name, unnest(string_split(name, '/')) AS part, generate_subscripts(string_split(name, '/'), 1) AS i FROM (
   SELECT p_partkey, replace(['../%', 'a/../%', '/%', '%', 'a/../../%/..', './%/b'][p_size % 6 + 1], '%', p_name) AS name FROM part)))
GROUP BY p_partkey""")
def _(spark, sf):
    shapes = F.array(*[F.lit(s) for s in ("../%", "a/../%", "/%", "%", "a/../../%/..", "./%/b")])
    name = F.replace(F.element_at(shapes, F.col("p_size") % 6 + 1), F.lit("%"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", T.is_safe_folder(name).alias("accepted"))


@query("fn_strip_order_prefix", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, concat(CASE WHEN l_partkey > 99 AND l_partkey < 1000 THEN '' ELSE concat(l_partkey, '_') END, l_suppkey, '.jpg') AS name FROM lineitem""")
def _(spark, sf):
    name = F.concat(F.concat_ws("_", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), F.lit(".jpg"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", T.strip_order_prefix(name).alias("name")
    )


@query("fn_compose_title", """
SELECT p_partkey, concat(['新款', '爆款', '热卖', '推荐'][(p_partkey * 7919 + 104729) % 4 + 1],
  ['潮流', '休闲', '时尚', '经典', '街头', '复古'][(p_partkey * 7919 + 2 * 104729) % 6 + 1], p_type,
  ['百搭', '时尚单品', '穿搭必备', '好物'][(p_partkey * 7919 + 3 * 104729) % 4 + 1]) AS title FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", listing.compose_title(F.col("p_partkey"), F.col("p_type")).alias("title"))


@query("fn_price", """
SELECT o_orderkey, round(9.9 + (((o_orderkey * 7919 + 5 * 104729) % 10007) / 10006.0::DOUBLE) * (199.9::DOUBLE - 9.9), 2) AS price, 25.0 AS fixed FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", listing.price(F.col("o_orderkey"), 9.9, 199.9).alias("price"), listing.price(F.col("o_orderkey"), 25).alias("fixed")
    )


@query("fn_listing_checks", with_views("listings", """
SELECT row, CASE WHEN selected THEN concat_ws(';', CASE WHEN trim(title) = '' THEN 'empty title' END,
  CASE WHEN try_cast(price_text AS DOUBLE) IS NULL THEN 'invalid price' WHEN try_cast(price_text AS DOUBLE) <= 0 THEN 'price <= 0' END) ELSE '' END AS warnings FROM listings"""))
def _(spark, sf):
    found = listing.check_listing(F.col("title"), F.col("price_text"), F.col("selected"))
    return W.listings(spark, sf).select("row", F.array_join(found, ";").alias("warnings"))


# Scan items: one per order, with the states the labels and filters look at.
W.SQL["items"] = """
SELECT o_orderkey AS row, concat('f', o_orderkey) AS folder,
  CASE o_orderstatus WHEN 'F' THEN 'duplicate' WHEN 'P' THEN 'review' ELSE 'new' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'broken' END AS error,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'deleted' END AS deleted,
  o_orderpriority = '2-HIGH' AS registered, 1 + o_orderkey % 3 AS group_count FROM orders
"""


def items(spark, sf):
    prio, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("folder"),
        F.when(st == "F", "duplicate").when(st == "P", "review").otherwise("new").alias("status"),
        F.when(prio == "5-LOW", "broken").alias("error"), F.when(prio == "1-URGENT", "deleted").alias("deleted"),
        (prio == "2-HIGH").alias("registered"), (1 + F.col("o_orderkey") % 3).alias("group_count"),
    )


@query("fn_dedup_label", with_views("items", """
SELECT row, CASE WHEN deleted IS NOT NULL THEN deleted WHEN registered THEN '已入库' WHEN error IS NOT NULL THEN 'X'
  WHEN status = 'duplicate' THEN '重复' WHEN status = 'review' THEN '待审' ELSE '新' END AS label FROM items"""))
def _(spark, sf):
    return items(spark, sf).select("row", L.dedup_label(*(F.col(c) for c in ("deleted", "registered", "error", "status"))).alias("label"))


@query("fn_split_label", with_views("items", """
SELECT row, CASE WHEN error IS NOT NULL THEN 'X' WHEN group_count > 1 THEN '!' ELSE 'OK' END AS label FROM items"""))
def _(spark, sf):
    return items(spark, sf).select("row", L.split_label(F.col("error"), F.col("group_count")).alias("label"))


@query("fn_process_label", """
SELECT l_orderkey, CASE WHEN failed > 0 THEN '!' WHEN n = 0 THEN '—' ELSE 'OK' END AS label FROM (
 SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS n, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS failed FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") != "N").alias("n"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("failed"),
    )
    return per.select("l_orderkey", L.process_label(F.col("failed"), F.col("n")).alias("label"))


# ── vectors ───────────────────────────────────────────────────

@query("fn_vec_decode", with_views("vecs", """
SELECT id, CASE WHEN id % 10 = 0 THEN -1 ELSE len(v) END AS dim, CASE WHEN id % 10 = 0 THEN 0 ELSE round(list_sum(v), 6) END AS total FROM vecs"""))
def _(spark, sf):
    blob = W.vecs(spark, sf).withColumn("blob", V.encode("v"))
    torn = blob.withColumn("blob", F.when(F.col("id") % 10 == 0, F.substring("blob", 1, 255)).otherwise(F.col("blob")))
    out = torn.select("id", V.decode("blob").alias("d"))
    total = F.aggregate(V.as_double(F.col("d")), F.lit(0.0), lambda a, x: a + x)
    return out.select("id", F.coalesce(F.size("d"), F.lit(-1)).alias("dim"), F.coalesce(F.round(total, 6), F.lit(0.0)).alias("total"))


@query("fn_vec_check_dim", with_views("vecs", "SELECT id, label <> 3 AS accepted FROM vecs"))
def _(spark, sf):
    v = W.vecs(spark, sf)
    dim = len(v.select("v").first()["v"])
    cut = v.withColumn("v", F.when(F.col("label") == 3, F.slice("v", 1, 60)).otherwise(F.col("v")))
    ok, bad = V.check_dim(cut, "v", dim)
    return ok.select("id", F.lit(True).alias("accepted")).unionByName(bad.select("id", F.lit(False).alias("accepted")))


@query("fn_l2_normalize", with_views("vecs", """
SELECT id, CASE WHEN n > 0 THEN round(s[1] / n, 6) ELSE 0 END + 0.0 AS first, CASE WHEN n > 0 THEN 1 ELSE 0 END AS length FROM (
 SELECT id, s, sqrt(list_inner_product(s, s)) AS n FROM (SELECT id, list_transform(v, lambda x: x * (id % 4)) AS s FROM vecs))"""))
def _(spark, sf):
    unit = V.l2_normalize(V.scale(F.col("v"), F.col("id") % 4))
    return W.vecs(spark, sf).select("id", unit.alias("u")).select(
        "id", (F.round(F.get("u", 0), 6) + 0.0).alias("first"), F.round(V.norm(F.col("u")), 6).alias("length")
    )


@query("fn_combine_vectors", with_views("vecs", """
SELECT id, round(c[1] / n, 6) + 0.0 AS first, round(c[len(c)] / n, 6) + 0.0 AS last, len(c) AS dim FROM (
 SELECT id, c, sqrt(list_inner_product(c, c)) AS n FROM (
  SELECT id, list_concat(v, list_transform(v[1:16], lambda x: x * 1.5)) AS c FROM vecs))"""))
def _(spark, sf):
    c = V.combine(F.col("v"), F.slice("v", 1, 16))
    return W.vecs(spark, sf).select("id", c.alias("c")).select(
        "id", (F.round(F.get("c", 0), 6) + 0.0).alias("first"), (F.round(F.element_at("c", -1), 6) + 0.0).alias("last"), F.size("c").alias("dim")
    )


# The last vector's neighbour is the first one.
W.SQL["neighbours"] = """
SELECT a.id, a.v, b.v AS w FROM vecs a JOIN vecs b ON b.id = CASE WHEN a.id = (SELECT max(id) FROM vecs) THEN (SELECT min(id) FROM vecs) ELSE a.id + 1 END"""


def wrapped(rows, key):
    """The key of the row whose neighbour a row is: one less, and the largest for the smallest."""
    ends = rows.agg(F.min(key), F.max(key)).first()
    return F.when(F.col(key) == ends[0], F.lit(ends[1])).otherwise(F.col(key) - 1)


def neighbours(spark, sf):
    v = W.vecs(spark, sf).select("id", "v")
    return v.join(v.select(wrapped(v, "id").alias("id"), F.col("v").alias("w")), "id")


@query("fn_dot", with_views("vecs neighbours", "SELECT id, round(list_inner_product(v, w), 6) + 0.0 AS sim FROM neighbours"))
def _(spark, sf):
    return neighbours(spark, sf).select("id", (F.round(V.dot(F.col("v"), F.col("w")), 6) + 0.0).alias("sim"))


@query("fn_cosine_distance", with_views("vecs neighbours", """
SELECT id, round(least(greatest(1.0 - list_inner_product(v, w), 0.0), 2.0), 6) AS distance FROM neighbours"""))
def _(spark, sf):
    return neighbours(spark, sf).select("id", F.round(V.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


@query("fn_hamming", with_views("albums", """
SELECT a.row, bit_count(xor(a.h0, b.h0))::INT + bit_count(xor(a.h1, b.h1)) + bit_count(xor(a.h2, b.h2)) + bit_count(xor(a.h3, b.h3)) AS distance
FROM albums a JOIN albums b ON b.row = CASE WHEN a.row = (SELECT max(row) FROM albums) THEN (SELECT min(row) FROM albums) ELSE a.row + 1 END"""))
def _(spark, sf):
    a = W.albums(spark, sf).select("row", "hash")
    b = a.select(wrapped(a, "row").alias("row"), F.col("hash").alias("other"))
    return a.join(b, "row").select("row", V.hamming(F.col("hash"), F.col("other")).alias("distance"))


@query("flt_zero_vectors", with_views("vecs", "SELECT id FROM vecs WHERE sqrt(list_inner_product(v, v)) * (label % 3) > 1e-6"))
def _(spark, sf):
    scaled = W.vecs(spark, sf).withColumn("v", V.scale(F.col("v"), F.col("label") % 3))
    return V.drop_zero(scaled, "v").select("id")
