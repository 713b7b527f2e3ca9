"""URL columns: owner names, resolving, image sizes, extensions, category ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from .binding import let
from .text import strip


def _nonempty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def username(url: Column, host: str) -> Column:
    """Owner of a shop URL: ``host/photos/{user}/…`` or ``//{user}.host``; else NULL."""
    quoted = re.escape(host)
    return F.coalesce(
        _nonempty(F.regexp_extract(url, quoted + r"/photos/([^/]+)", 1)),
        _nonempty(F.regexp_extract(url, r"//([^.]+)\." + quoted, 1)),
    )


def base_url(user: Column, host: str) -> Column:
    return F.concat(F.lit(f"https://{host}/photos/"), user)


def category_url(user: Column, category_id: Column, host: str) -> Column:
    return F.concat(
        base_url(user, host), F.lit("/albums?tab=gallery&referrercate="), category_id
    )


def _collapse_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(p == ".", acc)
        .otherwise(F.array_append(acc, p)),
    )
    last = F.element_at(parts, -1)
    text = F.array_join(
        F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"
    )
    # Climbing above the root ends at the root.
    return let(text, lambda t: F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)))


def resolve_url(base: Column, href: Column) -> Column:
    """``href`` as an absolute URL, seen from the folder ``base + '/'``."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.concat(F.substring(base, F.length(origin) + 1, F.lit(2**31 - 1)), F.lit("/"))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substring(href, F.length(path) + 1, F.lit(2**31 - 1))
    joined = F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path == "", F.concat(origin, folder, tail))
        .when(path.startswith("/"), F.concat(origin, _collapse_dots(path), tail))
        .otherwise(F.concat(origin, _collapse_dots(joined), tail))
    )


def cover_url(url: Column) -> Column:
    """Scheme-less cover links get ``https:``; empty ones stay empty."""
    u = F.coalesce(url, F.lit(""))
    return F.when((u == "") | u.startswith("http"), u).otherwise(F.concat(F.lit("https:"), u))


def resize_url(url: Column, size: str = S.IMAGE_SIZE) -> Column:
    """Ask for another rendition: the size word before the extension is replaced."""
    return F.regexp_replace(url, f"/({'|'.join(S.URL_SIZES)})\\.", f"/{size}.")


def url_extension(url: Column) -> Column:
    path = F.substring_index(url, "?", 1)
    ext = F.regexp_extract(path, r"(\.[^.]*)\z", 1)
    return F.when((ext != "") & (F.length(ext) <= S.MAX_EXTENSION_LENGTH), ext).otherwise(
        S.DEFAULT_EXTENSION
    )


def _query_value(href: Column, name: str) -> Column:
    query = F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)
    raw = _nonempty(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1))
    return F.coalesce(F.try_url_decode(raw), raw)


def category_id(href: Column) -> Column:
    """Category of a link: path segment first, then query parameters; NULL when absent."""
    return F.coalesce(
        _nonempty(F.regexp_extract(href, r"/categories/(\d+)", 1)),
        _query_value(href, "referrercate"),
        _query_value(href, "cate"),
    )


_COUNT_SUFFIX = r"\((\d+)\)$"


def category_count(name: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(name, _COUNT_SUFFIX, 1).try_cast("bigint"), F.lit(0).cast("bigint")
    )


def category_name(name: Column) -> Column:
    """Category text without its trailing ``(n)``."""
    return F.when(
        name.rlike(_COUNT_SUFFIX), strip(F.regexp_replace(name, _COUNT_SUFFIX, ""))
    ).otherwise(name)
