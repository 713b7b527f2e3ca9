"""Pages rendered from the part table, and the rows read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import html

from . import views as W
from .registry import query
from .text_queries import category_href
from .views import table, with_views

PER_PAGE = 50


def _pages(rows, page, order, item):
    """One text per page: at most a few dozen items each."""
    parts = rows.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("h")))).alias("p"))
    return parts.select("page", F.array_join(F.transform("p", lambda x: x["h"]), "\n").alias("body"))


def _s(col):
    return F.col(col).cast("string")


# Album listing: list layout on even pages, gallery layout on odd ones. Every tenth album
# shows up again at the end of the next page.
W.SQL["shown"] = f"""
SELECT p_partkey // {PER_PAGE} AS page, p_partkey % {PER_PAGE} AS slot, * FROM part
UNION ALL SELECT p_partkey // {PER_PAGE} + 1, {PER_PAGE} + p_partkey % {PER_PAGE}, * FROM part WHERE p_partkey % 10 = 0
"""
W.SQL["album_rows"] = f"""
SELECT page::BIGINT AS page, (row_number() OVER (PARTITION BY page ORDER BY slot) - 1)::INT AS pos, p_partkey::VARCHAR AS album_id,
 concat(p_name, ' & ', p_brand) AS title, concat('https://{W.HOST}/photos/', replace(p_brand, '#', ''), '/albums/', p_partkey, '?uid=1') AS url,
 CASE WHEN p_size % 8 = 0 THEN 0 ELSE p_size END AS image_count,
 CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('https://img.example.com/', p_partkey, '/small.jpeg') ELSE concat('http://img.example.com/', p_partkey, '/small.jpeg') END AS cover_url
FROM shown
"""


def album_pages(spark, sf):
    p = table(spark, sf, "part")
    slot = F.col("p_partkey") % PER_PAGE
    again = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    shown = p.withColumn("_again", F.explode(again)).select(
        "*", (F.floor(F.col("p_partkey") / PER_PAGE) + F.col("_again")).alias("page"), (slot + PER_PAGE * F.col("_again")).alias("slot")
    )
    listed = F.col("page") % 2 == 0
    title = F.concat("p_name", F.lit(" &amp; "), "p_brand")
    href = F.concat(F.lit("/photos/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/albums/"), _s("p_partkey"), F.lit("?uid=1"))
    count = F.when(F.col("p_size") % 8 == 0, F.lit("n/a")).otherwise(_s("p_size"))
    src = F.concat(F.when(F.col("p_size") % 3 == 1, F.lit("//img.example.com/")).otherwise(F.lit("http://img.example.com/")), _s("p_partkey"), F.lit("/small.jpeg"))
    img = lambda cls, attr: F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(f'<img class="{cls}" {attr}="'), src, F.lit('"/>'))
    )
    item = F.when(
        listed,
        F.concat(F.lit('<a class="album3__main x" title=" '), title, F.lit('" href="'), href, F.lit('" data-album-id="'), _s("p_partkey"),
                 F.lit('"><div class="album3__photonumber">'), count, F.lit("</div>"), img("album3__img", "data-src"), F.lit("</a>")),
    ).otherwise(
        F.concat(F.lit('<a class="album__main" href="'), href, F.lit('">'), img("album__img", "src"), F.lit('<div class="album__title"><b>'), title,
                 F.lit('</b></div><div class="album__photonumber"> '), count, F.lit("</div></a>"))
    )
    body = _pages(shown, F.col("page"), F.col("slot"), item)
    pager = F.concat(
        F.lit('<form class="pagination__jumpwrap"><input name="size" max="9"/>'),
        F.when(F.col("page") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit('<input name="page" max="'), F.when(F.col("page") % 3 == 1, _s("page")).otherwise("abc"), F.lit('">'))
        ),
        F.lit("</form>"),
    )
    return W.spread(body).select("page", F.concat(F.lit("<html><body><a href='/'>home</a>"), "body", pager, F.lit("</body></html>")).alias("html"))


@query("html_albums", with_views("shown album_rows", "SELECT * FROM album_rows"))
def _(spark, sf):
    return html.albums(album_pages(spark, sf), W.BASE)


@query("html_max_page", with_views("shown", "SELECT page::BIGINT AS page, CASE WHEN page % 3 = 1 THEN page ELSE 1 END AS max_page FROM shown GROUP BY page"))
def _(spark, sf):
    return html.max_page(album_pages(spark, sf))


@query("win_first_seen_album", with_views("shown album_rows", """
SELECT * FROM album_rows QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY page, pos) = 1"""))
def _(spark, sf):
    return html.first_seen(html.albums(album_pages(spark, sf), W.BASE))


# Album pages: one per folder of images; every fourth container is empty.
@query("html_album_images", with_views("vecs images", """
SELECT folder AS page, pos, concat('https://h/', image_id, '/big.jpeg') AS image_url FROM images WHERE image_id % 4 < 3"""))
def _(spark, sf):
    box = F.concat(
        F.lit('<div class="showalbum__children image"><div><img alt="" data-src="'),
        F.when(F.col("image_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("https://h/"), _s("image_id"), F.lit("/small.jpeg"))),
        F.lit('"></div><img data-src="https://h/second.jpeg"></div>'),
    )
    return html.album_images(_pages(W.images(spark, sf), F.col("folder"), F.col("pos"), box).withColumnRenamed("body", "html"))


# Category bars: a link per part, some without an id and some without text.
@query("html_categories", f"""
SELECT p_partkey // {PER_PAGE} AS page, (row_number() OVER (PARTITION BY p_partkey // {PER_PAGE} ORDER BY p_partkey) - 1)::INT AS slot, p_partkey::VARCHAR AS category_id,
 p_name AS name, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS album_count
FROM part WHERE p_size % 4 < 3 AND p_type <> 'ECONOMY'""")
def _(spark, sf):
    text = F.when(F.col("p_type") == "ECONOMY", F.lit(" ")).when(
        F.col("p_size") > 25, F.concat("p_name", F.lit(" ("), _s("p_size"), F.lit(")"))
    ).otherwise(F.col("p_name"))
    link = F.concat(F.lit('<a href="'), F.replace(category_href(_s("p_partkey")), F.lit("&"), F.lit("&amp;")), F.lit('">'), text, F.lit("</a><li><a href='/categories/1'>no</a></li>"))
    pages = _pages(table(spark, sf, "part"), F.floor(F.col("p_partkey") / PER_PAGE), F.col("p_partkey"), link).select(
        "page", F.concat(F.lit('<ul class="showheader__category">'), "body", F.lit('</ul><ul><a href="/categories/2">other</a></ul>')).alias("html")
    )
    found = html.categories(pages)
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1
    return found.withColumn("slot", slot).select("page", "slot", "category_id", "name", "album_count")


