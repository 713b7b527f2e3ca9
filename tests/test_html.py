from vitrine.operators import html

BASE = "https://shop.example.com/photos/u"
LIST = """<div><a class="album3__main" data-album-id="70021" title="First" href="/photos/u/albums/70021?uid=1">
<div class="album3__photonumber">41</div><img class="album3__img" data-src="//img.example.com/c.jpg"></a>
<a class="album3__main" data-album-id="70035" title="Second" href="/photos/u/albums/70035"><div class="album3__photonumber">17</div></a>
<a class="album__main" href="/photos/u/albums/5">not taken</a></div>"""
GALLERY = """<a class="album__main" href="/photos/u/albums/70112?x"><img class="album__img" src="https://i/1.jpg" data-origin-src="https://i/o.jpg">
<div class="album__title">Third &amp; <b>last</b></div><div class="album__photonumber">9</div></a><a class="album__main" href="/x"></a>"""


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page int, html string")


def test_albums(spark):
    rows = html.albums(pages(spark, LIST, GALLERY, "<p>none</p>"), BASE).orderBy("page", "pos").collect()
    got = [(r["page"], r["album_id"], r["title"], r["image_count"], r["cover_url"]) for r in rows]
    assert got == [
        (0, "70021", "First", 41, "https://img.example.com/c.jpg"), (0, "70035", "Second", 17, ""),
        (1, "70112", "Third &last", 9, "https://i/o.jpg"), (1, "", "", 0, ""),
    ]
    assert rows[0]["url"] == "https://shop.example.com/photos/u/albums/70021?uid=1"


def test_first_seen_drops_empty_ids(spark):
    seen = html.first_seen(html.albums(pages(spark, LIST, GALLERY, LIST), BASE))
    assert {(r["album_id"], r["page"]) for r in seen.collect()} == {("70021", 0), ("70035", 0), ("70112", 1)}


def test_album_images(spark):
    text = """<div class="showalbum__children"><img data-src="https://h/a7/small.jpeg"><img data-src="https://h/no/small.jpeg"></div>
    <div class="x showalbum__children"><div><img data-src="https://h/b9/medium.jpeg?a"></div></div>
    <div class="showalbum__children"><img data-src=""></div><div class="showalbum__children">none</div><img data-src="https://h/out.jpeg">"""
    got = [r["image_url"] for r in html.album_images(pages(spark, text)).orderBy("pos").collect()]
    assert got == ["https://h/a7/big.jpeg", "https://h/b9/big.jpeg?a"]


def test_max_page(spark):
    form = '<form class="pagination__jumpwrap"><input name="page" {}></form>'
    texts = [form.format('max="23"'), "<p></p>", form.format('max="abc"'), form.format(""), '<input name="page" max="9">']
    assert [r["max_page"] for r in html.max_page(pages(spark, *texts)).orderBy("page").collect()] == [23, 1, 1, 1, 1]


def test_categories(spark):
    text = """<ul class="showheader__category"><a href="/photos/u/categories/1">Shoes (3)</a><a href="?cate=2">Bags</a>
    <a href="/all">All</a><a href="?cate=4"> </a><li><a href="?cate=5">deep</a></li></ul>"""
    got = [(r["category_id"], r["name"], r["album_count"]) for r in html.categories(pages(spark, text)).orderBy("pos").collect()]
    assert got == [("1", "Shoes", 3), ("2", "Bags", 0)]
