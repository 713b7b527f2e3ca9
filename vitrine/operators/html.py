"""Listing, album and category pages to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# Class names and attributes that mark the parts of a page.
LIST_LINK, GALLERY_LINK = "album3__main", "album__main"
TITLE_CLASSES = ("album3__title", "album__title")
COUNT_CLASSES = ("album__photonumber", "album3__photonumber")
COVER_CLASSES = ("album__img", "album3__img")
COVER_SOURCES = ("data-origin-src", "data-src", "src")
PAGER_CLASS, PAGER_INPUT = "pagination__jumpwrap", "page"
IMAGE_BOX = "showalbum__children"
CATEGORY_LIST = "showheader__category"
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)


class _Page(HTMLParser):
    """Keeps the stack of open elements; subclasses look at it as tags come by."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        a["class"] = a.get("class", "").split()
        if tag not in VOID:
            self.stack.append((tag, a))
        self.opened(tag, a, len(self.stack))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    t, a = self.stack.pop()
                    self.closed(t, a, len(self.stack) + 1)
                return

    def handle_data(self, data):
        self.text(data.strip())

    def opened(self, tag, a, depth): ...

    def closed(self, tag, a, depth): ...

    def text(self, data): ...

    def rows(self) -> list[dict]:
        return self.found


class _Albums(_Page):
    def __init__(self):
        super().__init__()
        self.album: dict | None = None
        self.depth = 0
        self.part: tuple[str, int] | None = None

    def opened(self, tag, a, depth):
        classes = a["class"]
        if tag == "a" and (LIST_LINK in classes or GALLERY_LINK in classes):
            self.album = {
                "listed": LIST_LINK in classes,
                "data_id": a.get("data-album-id", ""),
                "href": a.get("href", ""),
                "title_attr": a.get("title", ""),
                "covers": {},
                "titles": {},
                "counts": {},
            }
            self.depth = depth
            self.found.append(self.album)
        elif self.album is None:
            return
        elif tag == "div":
            for kind, names in (("titles", TITLE_CLASSES), ("counts", COUNT_CLASSES)):
                for name in names:
                    if name in classes and name not in self.album[kind]:
                        self.album[kind][name] = ""
                        self.part = (kind + " " + name, depth)
        elif tag == "img":
            for name in COVER_CLASSES:
                if name in classes and name not in self.album["covers"]:
                    self.album["covers"][name] = next(
                        (a[s] for s in COVER_SOURCES if a.get(s)), ""
                    )

    def closed(self, tag, a, depth):
        if self.part and depth == self.part[1]:
            self.part = None
        if self.album is not None and depth == self.depth and tag == "a":
            self.album = None

    def text(self, data):
        if self.album is not None and self.part:
            kind, name = self.part[0].split()
            self.album[kind][name] += data

    def rows(self):
        listed = [f for f in self.found if f["listed"]]
        pick = lambda d, names: next((d[n] for n in names if n in d), None)
        return [
            {
                "data_id": f["data_id"],
                "href": f["href"],
                "title_attr": f["title_attr"],
                "title_text": pick(f["titles"], TITLE_CLASSES),
                "count_text": pick(f["counts"], COUNT_CLASSES),
                "cover": pick(f["covers"], COVER_CLASSES),
            }
            for f in (listed or self.found)
        ]


class _Images(_Page):
    def __init__(self):
        super().__init__()
        self.boxes: list[tuple[int, bool]] = []

    def opened(self, tag, a, depth):
        if tag == "div" and IMAGE_BOX in a["class"]:
            self.boxes.append((depth, False))
        elif tag == "img" and self.boxes and not self.boxes[-1][1]:
            self.boxes[-1] = (self.boxes[-1][0], True)
            self.found.append({"src": a.get("data-src", "")})

    def closed(self, tag, a, depth):
        if self.boxes and depth == self.boxes[-1][0]:
            self.boxes.pop()


class _Pager(_Page):
    def opened(self, tag, a, depth):
        inside = any(t == "form" and PAGER_CLASS in f["class"] for t, f in self.stack)
        if tag == "input" and inside and a.get("name") == PAGER_INPUT and not self.found:
            self.found.append({"max_text": a.get("max", "")})

    def rows(self):
        return self.found or [{"max_text": ""}]


class _Categories(_Page):
    def opened(self, tag, a, depth):
        parent = self.stack[-2] if len(self.stack) > 1 else ("", {"class": []})
        if tag == "a" and parent[0] == "ul" and CATEGORY_LIST in parent[1]["class"]:
            self.found.append({"href": a.get("href", ""), "name": "", "open": depth})

    def closed(self, tag, a, depth):
        if self.found and self.found[-1]["open"] == depth:
            self.found[-1]["open"] = None

    def text(self, data):
        if self.found and self.found[-1]["open"]:
            self.found[-1]["name"] += data


def _parse(pages: DataFrame, parser: Callable[[], _Page], fields: Iterable[str], key: str) -> DataFrame:
    """One row per element found, with its page key and 0-based position."""
    fields = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch[key], batch["html"]):
                p = parser()
                p.feed(html or "")
                p.close()
                out += [(page, i, *(r[f] for f in fields)) for i, r in enumerate(p.rows())]
            yield pd.DataFrame(out, columns=[key, "pos", *fields])

    kind = dict(pages.dtypes)[key]
    schema = ", ".join([f"{key} {kind}", "pos int", *(f"{f} string" for f in fields)])
    return pages.select(key, "html").mapInPandas(run, schema)


def albums(pages: DataFrame, base: str, key: str = "page") -> DataFrame:
    """Album rows of listing pages; the list layout wins over the gallery layout."""
    raw = _parse(
        pages, _Albums, ("data_id", "href", "title_attr", "title_text", "count_text", "cover"), key
    )
    album_id = F.when(F.col("data_id") != "", F.col("data_id")).otherwise(
        F.regexp_extract("href", r"/albums/(\d+)", 1)
    )
    return raw.select(
        key,
        "pos",
        album_id.alias("album_id"),
        T.title_or(F.col("title_attr"), F.col("title_text"), album_id).alias("title"),
        U.resolve_url(F.lit(base), F.col("href")).alias("url"),
        T.parse_count(F.coalesce("count_text", F.lit(""))).alias("image_count"),
        U.cover_url(F.col("cover")).alias("cover_url"),
    )


def max_page(pages: DataFrame, key: str = "page") -> DataFrame:
    """Highest page number named by the pager, 1 when absent or not a number."""
    raw = _parse(pages, _Pager, ("max_text",), key)
    number = F.when(
        F.col("max_text").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("max_text").try_cast("bigint")
    )
    return raw.select(key, F.coalesce(number, F.lit(1)).alias("max_page"))


def album_images(pages: DataFrame, key: str = "page", size: str = "big") -> DataFrame:
    """Image links of album pages in page order, repeats kept, asked for in one size."""
    raw = _parse(pages, _Images, ("src",), key)
    return raw.where(F.col("src").startswith("http")).select(
        key, "pos", U.resize_url(F.col("src"), size).alias("image_url")
    )


def categories(pages: DataFrame, key: str = "page") -> DataFrame:
    """Shop categories; links without text or without an id are left out."""
    raw = _parse(pages, _Categories, ("href", "name"), key)
    return (
        raw.where(F.col("name") != "")
        .withColumn("category_id", U.category_id(F.col("href")))
        .where(F.col("category_id").isNotNull())
        .select(
            key,
            "pos",
            "category_id",
            U.category_name(F.col("name")).alias("name"),
            U.category_count(F.col("name")).alias("album_count"),
        )
    )


_LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>'


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Ordered links of any page, with the page title, on regular expressions alone."""
    anchor = r'(?is)(<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>)'
    return (
        pages.select(
            key,
            F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("page_title"),
            F.posexplode(F.regexp_extract_all("html", F.lit(anchor), 1)).alias("pos", "_a"),
        )
        .withColumn("href", F.regexp_extract("_a", _LINK, 1))
        .withColumn("text", T.strip(F.regexp_replace("_a", r"<[^>]*>", "")))
        .drop("_a")
    )


def first_seen(albums: DataFrame, page: str = "page", pos: str = "pos") -> DataFrame:
    """First row of every album over all pages; rows without an id are dropped."""
    from .ordering import latest_per_key

    known = albums.where(F.coalesce(F.col("album_id"), F.lit("")) != "")
    return latest_per_key(known, ["album_id"], [F.col(page), F.col(pos)])
