"""Periodic runs of words: seeds of equal k-grams, extended along their diagonal.

A run with period q repeats its words at distance q over at least three more periods, so words
i and i + q agree on a stretch (a diagonal of lag q) of at least max(5, 3q) places. That is the
minimum guaranteed overlap, and it sets the seeds: lag 1 is looked for with 5-grams, the lags
from 2^j up to 2^(j+1) with grams of 3 * 2^j words.

1. Index: grams are named by doubling (the name of a 2k-gram is the pair of names of its halves),
   exactly and only where both halves occur again in the same document, so ordinary prose is
   done after a few steps.
2. Seeds: each occurrence of a gram is paired with the next one in the same document, if their
   distance is a lag of the level. A gram is longer than its lags, so it cannot occur between
   two of its places in a run: the next occurrence is one period away, the pairs are at most as
   many as the words, and a hot gram does no harm.
3. Extension: seeds of one lag are taken from left to right; a table holds how far that lag is
   covered, and seeds inside it are skipped. The others are extended to both sides in growing
   steps. Each stretch of a lag is so extended once.

The stretch of a seed has no smaller period: it holds the gram at two places d apart, two and a
half periods at least, so a smaller period would put the gram between them. Hence what is long
enough is a run, and no divisor of its lag has to be tried.

A null text has no words. Repeated rows stay, rows without a key too; other columns are not
looked at. A text is worked on as a whole, in n log n steps and some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.binding import let
from .common import SPACE, arrow_slices, texts

LEAST_WORDS = 6
LEAST_PERIODS = 4
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _rename(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names as small numbers, and which of them occur more than once."""
    _, small, counts = np.unique(names, return_inverse=True, return_counts=True)
    return small.astype(np.int64), counts[small] > 1


class Grams:
    """Places whose gram of ``width`` words occurs again in its document, and the names of these grams."""

    def __init__(self, places: np.ndarray, names: np.ndarray, width: int):
        small, again = _rename(names)
        self.places, self.names, self.width = places[again], small[again], width

    def followed_by(self, other: Grams) -> Grams:
        """Grams of this one and then ``other``, where both have a name."""
        if not len(self.places) or not len(other.places):
            return Grams(self.places[:0], self.names[:0], self.width + other.width)
        at = np.searchsorted(other.places, self.places + self.width)
        at[at == len(other.places)] = 0
        both = other.places[at] == self.places + self.width
        size = int(other.names.max()) + 1
        return Grams(self.places[both], self.names[both] * size + other.names[at[both]], self.width + other.width)

    def seeds(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(lag, place) of each pair of neighbouring occurrences with a lag from low up to high, sorted."""
        order = np.argsort(self.names, kind="stable")
        place, name = self.places[order], self.names[order]
        lag = place[1:] - place[:-1]
        good = (name[1:] == name[:-1]) & (lag >= low) & (lag < high)
        lag, place = lag[good], place[:-1][good]
        order = np.lexsort((place, lag))
        return lag[order], place[order]


def _reach(x: np.ndarray, start: int, stop: int, lag: int) -> int:
    """The first place from start on where x differs from x a lag further, or stop."""
    step = 32
    while start < stop:
        end = min(start + step, stop)
        equal = x[start:end] == x[start + lag : end + lag]
        if not equal.all():
            return start + int(equal.argmin())
        start, step = end, step * 4
    return stop


def _reach_back(x: np.ndarray, start: int, stop: int, lag: int) -> int:
    """The smallest place, not below stop, from which on x equals x a lag further up to start."""
    step = 32
    while start > stop:
        begin = max(start - step, stop)
        equal = (x[begin:start] == x[begin + lag : start + lag])[::-1]
        if not equal.all():
            return start - int(equal.argmin())
        start, step = begin, step * 4
    return stop


def extend(x: np.ndarray, ends: np.ndarray, lags: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that the sorted seeds lie on, as places of the whole batch."""
    out: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}  # by lag: the end of the last extended stretch
    at = 0
    while at < len(lags):
        lag, place = int(lags[at]), int(places[at])
        if place < covered.get(lag, 0):
            same = np.searchsorted(lags, lag, side="right")
            at += int(np.searchsorted(places[at:same], covered[lag]))
            continue
        doc = int(np.searchsorted(ends, place, side="right"))
        right = _reach(x, place + width, int(ends[doc]) - lag, lag)
        left = _reach_back(x, place, int(ends[doc - 1]), lag)
        covered[lag] = right
        if right - left + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
            out.append((left, right - left + lag, lag))
        at += 1
    return out


def runs(x: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of the documents whose word codes lie in ``x`` one after the other.

    ``ends`` has the n + 1 bounds of n documents, from 0. Sorted by start, then period.
    """
    sizes = np.diff(ends)
    if not len(x) or sizes.max() < LEAST_WORDS:
        return []
    doc = np.repeat(np.arange(len(sizes)), sizes)
    one = Grams(np.arange(len(x)), doc * (int(x.max()) + 1) + x, 1)
    two = one.followed_by(one)
    four = two.followed_by(two)
    five = four.followed_by(one)
    found = extend(x, ends, *five.seeds(1, 2), 5)
    grams, low = four.followed_by(two), 2
    while len(grams.places) and LEAST_PERIODS * low <= sizes.max():
        found += extend(x, ends, *grams.seeds(low, 2 * low), grams.width)
        grams, low = grams.followed_by(grams), 2 * low
    return sorted((s, n, q) for s, n, q in found)


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period, then the smallest start, then period."""
    top = max(1000 * n // q for _, n, q in found)
    return min((r for r in found if 1000 * r[1] // r[2] == top), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def _batch(values: list[str]) -> tuple[list, list, list[str]]:
    """Runs, the best run, and the text without its repeats, of each text."""
    tokens: list[bytes] = []
    ends = np.zeros(len(values) + 1, dtype=np.int64)
    for i, text in enumerate(values):
        tokens += text.encode().split()  # bytes split at ASCII white space only
        ends[i + 1] = len(tokens)
    x = pa.array(tokens, type=pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own: list[list[tuple[int, int, int]]] = [[] for _ in range(len(values))]
    step = np.zeros(len(tokens) + 1, dtype=np.int64)
    for s, n, q in runs(x, ends):
        i = int(np.searchsorted(ends, s, side="right")) - 1
        own[i].append((s - int(ends[i]), n, q))
        step[s + q] += 1
        step[s + n] -= 1
    dropped = np.cumsum(step)[:-1] > 0
    collapsed = []
    for i, found in enumerate(own):
        words = tokens[ends[i] : ends[i + 1]]
        if found:
            words = [words[j] for j in np.flatnonzero(~dropped[ends[i] : ends[i + 1]])]
        collapsed.append(b" ".join(words).decode())
    keys = ("start", "length", "period")
    rows = [[dict(zip(keys, r, strict=True)) for r in found] for found in own]
    return rows, [dict(zip(keys, best(found), strict=True)) if found else None for found in own], collapsed


def find(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, runs (array of start, length, period), best (one of them or null) and collapsed text, a row per row.

    ``collapsed`` keeps the words outside runs and the first period of each run, joined by one
    space. A text without words gives no runs and an empty collapsed text.
    """
    src = texts(docs, key)

    schema = T.StructType([T.StructField(key, src.schema[key].dataType), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text"):
            columns = _batch(part["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([part[key].cast(arrow.field(0).type), *(pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return src.mapInArrow(run, schema)


def repeated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and text; the texts of a tenth of the documents repeat themselves from some word on.

    With h the crc32 of the decimal key: if h % 10 is 0 and there are n > 0 words, each word
    i >= a becomes word a + (i - a) % p, where g = floor(h / 10), a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Documents without a key stay as they are.
    """
    src = texts(docs, key)
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def looped(words: Column, n: Column) -> Column:
        def place(a: Column, p: Column) -> Column:
            i = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
            return F.array_join(F.transform(i, lambda j: F.get(words, j.cast("int"))), " ")

        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)).cast("long"), lambda p: place(a, p)))

    words = F.filter(F.split("text", SPACE, -1), lambda w: w != "")
    changed = let(words, lambda w: let(F.size(w).cast("long"), lambda n: F.when(n > 0, looped(w, n)).otherwise("")))
    return src.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
