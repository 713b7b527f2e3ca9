"""Main text of web pages by the line-block distribution.

A page becomes a list of lines, one per block element, with their text lengths. Menus,
forms, adverts and other parts that markup names as such are stripped and leave an empty
line; link text counts nothing. Lengths are summed over sliding windows of lines: the sum
surges where the text starts and dives to nothing where it ends, and all lines between a
surge and its dive are kept, short ones too. A surge is 86 characters, or half the largest
window of the page where that is less, so the strongest text of any page is kept. Windows do
not reach across the edge of an ``article`` or ``main``; where these hold at least half of
the page's text outside links, their lines weigh three times as much, and short lines
between the last dive and a surge are kept like those after it.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW_LINES = 3
SURGE_CHARS = 86
#: On a page whose largest window holds less than twice the surge, this share of that window is one.
SURGE_SHARE = 0.5
MARKED_WEIGHT = 3

# Element names of HTML and the usual names of page parts.
RAW = "script|style|noscript|template|iframe|title|textarea"
EMBEDDED = frozenset("object svg canvas".split())
STRIPPED = frozenset("head nav header footer aside form menu dialog select button fieldset label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q s samp small "
    "span strike strong sub sup time tt u var wbr br label ruby rt rp".split()
)
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead comment comments replies respond disqus cookie cookies consent notice alert promo sponsor sponsored "
    "share sharing social related newsletter subscribe signup popup modal widget toolbar pagination".split()
)
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WHOLE = frozenset(("html", "body", "main"))

MARKUP = re.compile(
    rf"(?is)<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"
)
HAS_EMBEDDED = re.compile(r"(?i)<(?:object|svg|canvas)[\s/>]")
ATTRIBUTE = re.compile(r"(?s)([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*))?")
#: Words that say what a container has beside it, not what it is.
NOT_ITSELF = frozenset("has with no not without".split())
#: A part name is not believed on a page where what it names holds more than this share of the text
#: outside links: for a whole class or id, and for its first or last word only.
BELIEVED = {True: 0.75, False: 0.5}


def _embedded_ends(page: str) -> dict[int, int]:
    """Where the svg, object and canvas elements with an end tag begin and end; one without has no content."""
    opened: dict[str, list[int]] = {tag: [] for tag in EMBEDDED}
    out: dict[int, int] = {}
    for m in MARKUP.finditer(page) if HAS_EMBEDDED.search(page) else ():
        tag = (m[3] or m[6] or "").lower()
        if tag not in EMBEDDED:
            continue
        if m[2] or m[5]:
            if opened[tag]:
                out[opened[tag].pop()] = m.end()
        elif not (m[4] or m[7] or "").rstrip().endswith("/"):
            opened[tag].append(m.start())
    return out


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), value.strip(value[:1] if value[:1] in "\"'" else None).lower())
    return out


def _part_name(attributes: dict[str, str]) -> tuple[str, bool] | None:
    """The part that a class or id names, and whether with all of the word."""
    compound = None
    for token in (*attributes.get("class", "").split(), attributes.get("id", "").strip()):
        if token in PART_NAMES:
            return token, True
        words = [w for w in re.split(r"[\s_-]+", token) if w]
        if words and NOT_ITSELF.isdisjoint(words):
            compound = compound or next(((w, False) for w in (words[-1], words[0]) if w in PART_NAMES), None)
    return compound


def _is_part(tag: str, attributes: dict[str, str]) -> bool:
    """Whether the element or its attributes say so outright."""
    return tag in STRIPPED or tag not in WHOLE and (
        "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in PART_ROLES
    )


def lines(page: str) -> list[tuple[str, int, str]]:
    """(text, characters outside links, container) per block; a stripped part is ("", 0, "")."""
    out: list[tuple[str | None, int, str, tuple]] = []
    stack: list[str] = []
    texts: list[str] = []
    outside: list[str] = []
    skip = links = 0  # how deep the stack was when a part began; open links
    kinds = {"article": 0, "main": 0}
    parts: list[tuple[str, bool]] = []  # the open containers that a class or id names as a part
    depths: list[int] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open on the stack

    def flush() -> None:
        text = " ".join("".join(texts).split())
        if text:
            inside = "article" if kinds["article"] else "main" if kinds["main"] else ""
            out.append((text, len(" ".join("".join(outside).split())), inside, tuple(parts)))
        texts.clear()
        outside.clear()

    def pop_to(depth: int) -> None:
        nonlocal skip, links
        if depths and depth < depths[-1]:
            flush()
            while depths and depth < depths[-1]:
                depths.pop()
                parts.pop()
        for tag in stack[depth:]:
            links -= tag == "a"
            if tag in kinds:
                kinds[tag] -= 1
            places[tag].pop()
        del stack[depth:]
        if skip and depth < skip:
            skip = 0

    def find(tags: tuple[str, ...], stop: frozenset) -> int:
        """Where the innermost of ``tags`` is open, unless one of ``stop`` is open inside it; -1 if nowhere."""
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=-1)
        at = last(tags)
        return at if at >= 0 and at >= last(stop) else -1

    def characters(raw: str) -> None:
        if raw and not skip:
            text = html_lib.unescape(raw)
            texts.append(text)
            if not links:
                outside.append(text)

    place = 0
    ends = _embedded_ends(page)
    for m in MARKUP.finditer(page):
        if m.start() < place:
            continue  # inside an embedded element
        characters(page[place : m.start()])
        place = ends.get(m.start(), m.end())
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in ("title", "script", "style"):
                texts.append(" ")
            continue
        if m[6] and not m[0].endswith(">"):
            break  # a tag that the end of the page cut off
        if tag in EMBEDDED:
            texts.append(" ")
            continue
        block = tag not in INLINE
        if block and not skip:
            flush()
        elif tag in ("br", "img", "input") and not skip:
            texts.append(" ")
            outside.append(" ")
        if m[2] or m[5]:
            depth = find((tag,), frozenset() if block else frozenset(("td", "th", "li", "article", "section", "div")))
            if depth >= 0:
                pop_to(depth)
            continue
        attributes = m[4] or m[7] or ""
        if block and tag not in VOID:
            p = find(("p",), frozenset(("button", "td", "th", "table", "li", "div", "section", "article")))
            if p >= 0:
                pop_to(p)
            own = CLOSES_ITSELF.get(tag)
            if own and (i := find(own, frozenset(("ul", "ol", "dl", "table", "select")))) >= 0:
                pop_to(i)
        if tag in VOID or attributes.rstrip().endswith("/") and not block:
            continue
        places[tag].append(len(stack))
        stack.append(tag)
        links += tag == "a"
        if tag in kinds:
            kinds[tag] += 1
        if skip:
            continue
        named = _attributes(attributes) if attributes else {}
        if _is_part(tag, named):
            flush()
            out.append(("", 0, "", tuple(parts)))
            skip = len(stack)
        elif named and tag not in WHOLE and (part := _part_name(named)) and part not in parts:
            flush()
            parts.append(part)
            depths.append(len(stack))
            out.append((None, 0, "", tuple(parts)))
    characters(page[place:])
    flush()
    return _without_parts(out)


def _without_parts(found: list[tuple[str | None, int, str, tuple]]) -> list[tuple[str, int, str]]:
    """The lines outside the named parts, each of which began with None and leaves an empty line.

    What holds most of the page's text is no part, whatever its class or id; less than a surge
    of text is, unless there is no other.
    """
    held: dict[tuple[str, bool], int] = {}
    for _, chars, _, parts in found:
        for part in parts:
            held[part] = held.get(part, 0) + chars
    total = sum(chars for _, chars, _, _ in found)
    doubted = {part for part, chars in held.items() if chars > BELIEVED[part[1]] * total and (chars >= SURGE_CHARS or chars == total)}
    out = []
    for text, chars, inside, parts in found:
        around, own = (parts, None) if text is not None else (parts[:-1], parts[-1])
        if doubted.issuperset(around) and own not in doubted:
            out.append((text or "", chars, inside))
    return out


def main_text(page: str, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    found = lines(page)
    total = sum(chars for _, chars, _ in found)
    # Marks count only where they hold the better part: an article may also be a teaser beside the story.
    heavy: tuple[str, ...] = ()
    for marked in (("article",), ("article", "main")):
        held = sum(chars for _, chars, kind in found if kind in marked)
        if held and 2 * held >= total:
            heavy = marked
            break
    weights = [chars * MARKED_WEIGHT if kind in heavy else chars for _, chars, kind in found]
    sums: list[int] = []
    ends: list[int] = []
    start = 0
    while start < len(found):
        end = start
        # An empty line is a stripped part and belongs to what is before it, or else to what follows.
        kind = found[start][2] if start else next((k for text, _, k in found if text), "")
        while end < len(found) and (not found[end][0] or found[end][2] == kind):
            end += 1
        sums += [sum(weights[i : min(i + window, end)]) for i in range(start, end)]
        ends += [end] * (end - start)
        start = end
    least = min(surge, SURGE_SHARE * max(sums, default=0))
    kept, i = [], 0
    first = 0  # of the lines since the last dive or edge
    while i < len(found):
        if not sums[i] or i and ends[i] != ends[i - 1]:
            first = i
        if sums[i] < least or not weights[i]:
            i += 1
            continue
        end = ends[i]
        if found[i][2] in heavy:
            while not weights[first]:
                first += 1
            i = first
        while i < end and sums[i]:
            if found[i][0]:
                kept.append(found[i][0])
            i += 1
        first = i
    return "\n\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> DataFrame:
    """key, url and text (the main text, empty if there is none) of every page.

    Null and empty pages give empty texts; repeated rows and null keys stay; other columns
    are not looked at. A page cut off in the middle keeps its text up to the cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "html"):
            yield pd.DataFrame({key: part[key], "url": part["url"], "text": [main_text(h, window, surge) for h in part["html"]]})

    src = pages.select(key, "url", F.coalesce("html", F.lit("")).alias("html"))
    return src.mapInPandas(run, f"{key} {dict(src.dtypes)[key]}, url string, text string")
