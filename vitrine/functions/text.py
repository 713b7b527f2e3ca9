"""Name, title, count and path columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S
from .binding import let

# Characters counted as white space, and those a folder name may not hold.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ILLEGAL = r'[\\/:*?"<>|]'


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col, f"\\A{SPACE}+|{SPACE}+\\z", "")


def sanitize_name(name: Column) -> Column:
    """A title made safe to be a folder name."""
    or_untitled = lambda c: F.when(c == "", F.lit(S.UNTITLED)).otherwise(c)
    clean = F.regexp_replace(strip(name), ILLEGAL, "_")
    clean = F.regexp_replace(clean, "[_ ]{2,}", "_")
    clean = let(F.regexp_replace(clean, r"\A[ _.]+|[ _.]+\z", ""), or_untitled)

    def unreserve(c: Column) -> Column:
        stem = F.upper(F.substring_index(c, ".", 1))
        return F.when(stem.isin(*S.RESERVED_NAMES), F.concat(F.lit("_"), c)).otherwise(c)

    short = F.substring(let(clean, unreserve), 1, S.MAX_NAME_LENGTH)
    return let(F.regexp_replace(short, r"[ _.]+\z", ""), or_untitled)


def parse_count(text: Column) -> Column:
    """Whole number written in ``text``, or 0."""
    t = strip(text)
    number = F.regexp_replace(t, "_", "").try_cast("bigint")
    return F.when(t.rlike(r"^[+-]?\d+(_\d+)*$"), F.coalesce(number, F.lit(0))).otherwise(
        F.lit(0).cast("bigint")
    )


def title_or(attribute: Column, inner: Column, fallback: Column) -> Column:
    """Title attribute, else inner text (even if empty), else ``fallback``."""
    return F.coalesce(F.nullif(strip(attribute), F.lit("")), strip(inner), fallback)


def image_filename(pos: Column, extension: Column) -> Column:
    """File name of the image at 0-based ``pos`` of its album."""
    return F.format_string("%02d%s", pos + 1, extension)


def strip_order_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d{3}_", "")


def is_safe_folder(name: Column) -> Column:
    """True when ``name`` stays inside the folder it is joined to."""
    depth = F.aggregate(
        F.split(name, "/"),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["now"] + _step(p)).alias("now"),
            F.least(acc["low"], acc["now"] + _step(p)).alias("low"),
        ),
    )
    return ~name.startswith("/") & (depth["low"] >= 0)


def _step(part: Column) -> Column:
    return F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)


def is_image_name(path: Column) -> Column:
    """Path ends in one of the image extensions, in any case."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
    return suffix.isin(*S.IMAGE_EXTENSIONS)


# Leading bytes of JPEG, PNG, RIFF, GIF and BMP files.
MAGIC_HEX = ("FFD8FF", "89504E470D0A", "52494646", "474946383761", "474946383961", "424D")


def is_image_content(content: Column) -> Column:
    """Header check: at least four bytes, starting like an image file."""
    head = F.hex(F.substring(content, 1, 12))
    hit = F.lit(False)
    for magic in MAGIC_HEX:
        hit = hit | head.startswith(magic)
    return F.coalesce((F.length(head) >= 8) & hit, F.lit(False))
