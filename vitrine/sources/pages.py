"""Listing pages in crawl order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered, parts_for, place, split_points

#: Pages carry their documents, so a chunk has fewer of them than of plain rows.
PAGE_ROWS = 16_384


def listing_pages(pages: DataFrame, order: str, url: str = "url", html: str = "html", chunk_rows: int = PAGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(page, url, html) of the pages with a document, numbered from 1 in the order of ``order``, and the pages without one.

    A page whose document is null or blank is no page of the listing: it is returned apart, with
    its place in ``order``. Pages are numbered chunk by chunk.
    """
    rows = pages.select(F.col(order).alias("place"), F.col(url).alias("url"), F.col(html).alias("html"))
    blank = F.coalesce(F.trim("html"), F.lit("")) == ""
    kept = rows.where(~blank)
    parts = parts_for(kept.count(), chunk_rows)
    chunk = place(F.col("place"), split_points(kept, "place", parts)) if parts > 1 else F.lit(0)
    return numbered(kept, [], [F.col("place")], "page", chunk).select("page", "place", "url", "html"), rows.where(blank).select("place", "url")
