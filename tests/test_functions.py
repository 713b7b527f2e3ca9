from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import tables as UT
from vitrine.functions import text as T
from vitrine.functions import urls as U
from vitrine.functions import vectors as V

HOST = "shop.example.com"


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_username(spark):
    urls = [
        f"https://{HOST}/photos/anna/albums", f"https://{HOST}/photos/anna?x=1", f"https://bob.{HOST}/albums?tab=a",
        f"https://{HOST}/photos/carl/categories/12", "https://example.org/", "nonsense",
    ]
    assert each(spark, urls, lambda c: U.username(c, HOST)) == ["anna", "anna?x=1", "bob", "carl", None, None]


def test_sanitize_name(spark):
    cases = {
        "Nike Air Max 90": "Nike Air Max 90", "product:size<M>/test": "product_size_M_test", "  . product . ": "product",
        "": "untitled", "...": "untitled", "a" * 300: "a" * 200, "hello   world__test": "hello_world_test",
        "CON": "_CON", "nul": "_nul", "COM1": "_COM1", "con.txt": "_con.txt", "a" * 199 + ".": "a" * 199,
        "　wide ": "wide", "a" * 198 + ". b": "a" * 198, "x._\n\ny": "x._\n\ny",
    }
    assert each(spark, list(cases), T.sanitize_name) == list(cases.values())


def test_resize_url(spark):
    urls = [f"https://h/a/{s}.jpeg" for s in ("small", "medium", "original", "square", "big", "huge")] + ["https://h/small.x/large.png?t=1"]
    want = ["https://h/a/big.jpeg"] * 5 + ["https://h/a/huge.jpeg", "https://h/big.x/big.png?t=1"]
    assert each(spark, urls, U.resize_url) == want


def test_url_extension(spark):
    urls = ["http://h/a.jpeg", "http://h/a.jpg", "http://h/a.png", "http://h/a.webp", "http://h/a.png?v=1.22", "nodots", "http://h/a.toolong"]
    assert each(spark, urls, U.url_extension) == [".jpeg", ".jpg", ".png", ".webp", ".png", ".jpeg", ".jpeg"]


def test_resolve_url_like_the_standard(spark):
    base = f"https://{HOST}/photos/anna"
    hrefs = [
        "/photos/x/albums/1?uid=1", "albums/1", "../b", "./c/./d", "../../../e", "//cdn.example.org/i.png", "http://o.example.org/z",
        "?page=2", "#top", "", "/a/../b/./c", "x/..", "mailto:me@example.org",
    ]
    got = each(spark, hrefs, lambda c: U.resolve_url(F.lit(base), c))
    assert got == [urljoin(base + "/", h) for h in hrefs]


def test_category_id_and_name(spark):
    hrefs = ["/photos/u/categories/12?cate=3", "?referrercate=7&cate=8", "/x?cate=9#f", "/x?referrercate=", "/x?cate=a%20b", "/x"]
    assert each(spark, hrefs, U.category_id) == ["12", "7", "9", None, "a b", None]
    names = ["Shoes (12)", "Shoes(3)", "Shoes (x)", "(4)"]
    assert each(spark, names, U.category_name) == ["Shoes", "Shoes", "Shoes (x)", ""]
    assert each(spark, names, U.category_count) == [12, 3, 0, 4]


def test_counts_and_titles(spark):
    assert each(spark, ["12", " 7 ", "x", "", "+5", "1_000", "-3", "1.5"], T.parse_count) == [12, 7, 0, 0, 5, 1000, -3, 0]
    df = spark.createDataFrame([(" a ", "b"), ("", " b "), ("", None), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(T.title_or(F.col("a"), F.col("b"), F.lit("id"))).collect()]
    assert got == ["a", "b", "id", ""]


def test_image_heads(spark):
    heads = [b"\xff\xd8\xff\xe0abc", b"\x89PNG\r\n\x1a\n", b"RIFF1234WEBP", b"GIF89a..", b"GIF87a..", b"BM66", b"<html>", b"", b"BM"]
    assert each(spark, [bytearray(h) for h in heads], T.is_image_content, "binary") == [True] * 6 + [False] * 3


def test_image_names_and_paths(spark):
    names = ["d/a.jpg", "d/a.JPEG", "d/a.Png", "d/a.webp", "d/a.bmp", "d/a.txt", "d/jpg", "d/.jpg", "d.jpg/a"]
    assert each(spark, names, T.is_image_name) == [True] * 5 + [False] * 4
    safe = ["a", "a/b", "a/../b", "..", "a/../../b", "/a", "./a"]
    assert each(spark, safe, T.is_safe_folder) == [True, True, True, False, False, False, True]
    assert each(spark, ["001_a.jpg", "01_a.jpg", "0001_a"], T.strip_order_prefix) == ["a.jpg", "01_a.jpg", "0001_a"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(
        V.l2_normalize(F.col("a")).alias("u"), V.dot(F.col("a"), F.col("b")).alias("d"), V.combine(F.col("a"), F.col("b")).alias("c"),
        V.cosine_distance(F.col("b"), F.col("b")).alias("z"),
    ).collect()
    assert rows[0]["u"] == pytest.approx([0.6, 0.8]) and rows[1]["u"] == [0.0, 0.0]
    assert [r["d"] for r in rows] == [4.0, 0.0] and [r["z"] for r in rows] == [0.0, 0.0]
    want = np.array([3, 4, 0, 1.5]) / np.linalg.norm([3, 4, 0, 1.5])
    assert rows[0]["c"] == pytest.approx(list(want))


def test_decode(spark):
    blobs = [bytearray(np.array([1.5, -2], "<f4").tobytes()), bytearray(b""), bytearray(b"abc"), None]
    assert each(spark, blobs, V.decode, "binary") == [[1.5, -2.0], None, None, None]


def test_hamming(spark):
    df = spark.createDataFrame([([0, 0, 0, 0], [255, 0, 0, -1])], "a array<bigint>, b array<bigint>")
    assert df.select(V.hamming(F.col("a"), F.col("b"))).first()[0] == 72


def test_html_links_table_function(spark):
    UT.register(spark)
    spark.createDataFrame([("<a href='no'>n</a><a class=x href=\"/a\"><b>A</b></a> <A HREF=\"/b\">B</A>",)], "html string").createOrReplaceTempView("one_page")
    got = spark.sql("SELECT l.* FROM one_page, LATERAL html_links(html) l").collect()
    assert [tuple(r) for r in got] == [(0, "/a", "A"), (1, "/b", "B")]
