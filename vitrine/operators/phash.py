"""Near-equal perceptual hashes, found through shared bands, and album duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.vectors import hamming
from ..session import cut
from .blocks import block_pairs, ints, list_column, matrix
from .leaders import greedy_leaders

DIGITS = S.PHASH_BITS // 4


def hash_text(words: Column) -> Column:
    """``array<bigint>`` hash as hexadecimal digits."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def _cuts(length: int, bands: int) -> list[tuple[int, int]]:
    edge = [length * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def bands(hashes: DataFrame, threshold: int = S.PHASH_THRESHOLD) -> DataFrame:
    """One row per hash and band.

    ``threshold`` flipped bits cannot touch all of ``threshold + 1`` bands, so two hashes
    within the threshold share at least one band key.
    """
    text = hashes.withColumn("_t", hash_text(F.col("hash")))
    keys = [
        F.concat(F.lit(f"{i}:"), F.substring("_t", a + 1, n))
        for i, (a, n) in enumerate(_cuts(DIGITS, threshold + 1))
    ]
    return text.withColumn("band", F.explode(F.array(*keys))).drop("_t")


def band_keys(
    hashes: DataFrame, threshold: int = S.PHASH_THRESHOLD, limit: int = S.BLOCK_ROWS
) -> DataFrame:
    """Band keys; bands shared by more than ``limit`` hashes get a second level.

    A pair sharing a hot band still differs in at most ``threshold`` bits elsewhere, so it
    shares one of the ``threshold + 1`` pieces of the remaining digits as well: the finer
    key loses nothing.
    """
    first = bands(hashes, threshold)
    hot = first.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    tagged = first.join(hot, "band", "left")
    spans = _cuts(DIGITS, threshold + 1)
    # Digits outside the hot band, by band number.
    text = hash_text(F.col("hash"))
    number = F.substring_index("band", ":", 1).cast("int")
    rest = F.lit(None).cast("string")
    for i, (a, n) in enumerate(spans):
        rest = F.when(
            number == i, F.concat(F.substring(text, 1, a), F.substring(text, a + n + 1, DIGITS))
        ).otherwise(rest)
    shortest = DIGITS - max(n for _, n in spans)
    pieces = _cuts(shortest, threshold + 1)
    finer = [
        F.concat(
            F.col("band"), F.lit(f"/{j}:"),
            F.substring("_rest", a + 1, n if j < len(pieces) - 1 else DIGITS),
        )
        for j, (a, n) in enumerate(pieces)
    ]
    keys = F.when(F.col("_n").isNull(), F.array("band")).otherwise(F.array(*finer))
    return tagged.withColumn("_rest", rest).withColumn("key", F.explode(keys)).drop("_rest", "_n", "band")


def distinct_hashes(hashes: DataFrame, row: str = "row") -> DataFrame:
    """Every hash once, at its first row."""
    return hashes.groupBy("hash").agg(F.min(row).alias(row))


def _heads(keyed: DataFrame, row: str, threshold: int) -> DataFrame:
    """(row, head, head hash) where the first row of a key is a match of a later one.

    Nothing in the key comes before its head, so these rows need no pairs: a mass of
    near-copies is settled against one hash.
    """
    first = keyed.groupBy("key").agg(F.min(F.struct(row, "hash")).alias("_f"))
    near = (F.col(f"_f.{row}") < F.col(row)) & (hamming(F.col("hash"), F.col("_f.hash")) <= threshold)
    return keyed.join(first, "key").where(near).select(
        row, "hash", "key", F.col(f"_f.{row}").alias("_o"), F.col("_f.hash").alias("_oh")
    )


def _marked(keyed: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """``keyed`` with ``hot`` (its key is shared by more than ``limit`` hashes), and whether any is."""
    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("key", F.lit(True).alias("hot")))
    if large.isEmpty():
        return keyed.withColumn("hot", F.lit(False)), False
    return cut(keyed.join(large, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))), True


def _earlier(rest: DataFrame, others: DataFrame, row: str, threshold: int, any_hot: bool = False, limit: int = S.BLOCK_ROWS) -> DataFrame:
    """(_row, _h, _o, _oh): earlier near hashes that share a key. Of a hot key only the first one
    per row and block: its members meet block by block, and no pairs leave a task."""
    a = rest.select(F.col(row).alias("_row"), F.col("hash").alias("_h"), "key", "hot")
    b = others.select(F.col(row).alias("_o"), F.col("hash").alias("_oh"), "key", "hot")
    near = (F.col("_o") < F.col("_row")) & (hamming(F.col("_h"), F.col("_oh")) <= threshold)
    found = a.where("NOT hot").drop("hot").join(b.where("NOT hot").drop("hot"), "key").where(near).select("_row", "_h", "_o", "_oh")
    if not any_hot:
        return found

    def first(x: pa.Table, y: pa.Table) -> pa.Table:
        rows, others_ = ints(x["_row"]), ints(y["_o"])
        if not len(rows) or not len(others_):
            return pa.table({"_row": pa.array([], pa.int64()), "_h": pa.array([], pa.list_(pa.int64())), "_o": pa.array([], pa.int64()), "_oh": pa.array([], pa.list_(pa.int64()))})
        h, oh = matrix(x["_h"], np.int64), matrix(y["_oh"], np.int64)
        order = np.argsort(others_, kind="stable")
        best = np.full(len(rows), -1)
        for start in range(0, len(rows), 256):
            part = slice(start, start + 256)
            bits = sum(np.bitwise_count(h[part, w, None] ^ oh[None, order, w]).astype(np.int16) for w in range(h.shape[1]))
            fit = (bits <= threshold) & (others_[order][None, :] < rows[part, None])
            best[part] = np.where(fit.any(axis=1), fit.argmax(axis=1), -1)
        hit = np.flatnonzero(best >= 0)
        to = order[best[hit]]
        return pa.table({"_row": rows[hit], "_h": list_column(h[hit], pa.int64()), "_o": others_[to], "_oh": list_column(oh[to], pa.int64())})

    hot = block_pairs(a.where("hot").drop("hot"), b.where("hot").drop("hot"), first, "_row long, _h array<bigint>, _o long, _oh array<bigint>", "_row", "_o", "key", limit)
    return found.select(F.col("_row").cast("long").alias("_row"), "_h", F.col("_o").cast("long").alias("_o"), "_oh").unionByName(hot)


def first_neighbour(hashes: DataFrame, row: str = "row", threshold: int = S.PHASH_THRESHOLD, limit: int = S.BLOCK_ROWS) -> DataFrame:
    """For every row with an earlier row within ``threshold`` bits: the first such row.

    Rows of one hash are joined as one, so a mass of copies adds a single hash to the
    band join; its later rows point at its first one or at an even earlier neighbour.
    Within a key only rows that do not match its head are compared with the others; keys
    that still hold more than ``limit`` hashes are compared in blocks.
    """
    once = distinct_hashes(hashes, row)
    keyed, any_hot = _marked(cut(band_keys(once, threshold)), limit)
    by_head = cut(_heads(keyed, row, threshold))
    others = keyed.join(by_head.select(row, "key"), [row, "key"], "left_anti")
    found = by_head.select(F.col("hash").alias("_h"), "_o", "_oh").unionByName(
        _earlier(others, keyed, row, threshold, any_hot, limit).select("_h", "_o", "_oh")
    )
    near = (
        found.groupBy("_h")
        .agg(F.min(F.struct("_o", "_oh")).alias("_best"))
        .select(
            F.col("_h").alias("hash"), F.col("_best._o").alias("_near"),
            hamming(F.col("_h"), F.col("_best._oh")).alias("_distance"),
        )
    )
    firsts = once.withColumnRenamed(row, "_first").join(near, "hash", "left")
    own = F.col(row) == F.col("_first")
    return (
        hashes.join(firsts, "hash")
        .withColumn("match_row", F.coalesce("_near", F.when(~own, F.col("_first"))))
        .withColumn("distance", F.coalesce("_distance", F.lit(0)))
        .where(F.col("match_row").isNotNull())
        .select(row, "match_row", "distance")
    )


def cover_duplicates(hashes: DataFrame, row: str = "row", threshold: int = S.PHASH_THRESHOLD, limit: int = S.BLOCK_ROWS) -> DataFrame:
    """(row, match_row) of covers within ``threshold`` bits of an earlier kept cover.

    ``match_row`` is the first kept row that matches. Copies of a hash are never kept, so
    the greedy pass runs over distinct hashes, and rows near the head of a key are known
    to have an earlier match before any pairs are looked at.
    """
    once = distinct_hashes(hashes, row)
    keyed, any_hot = _marked(cut(band_keys(once, threshold)), limit)
    with_keys = lambda df: df.join(keyed.select(row, "key", "hot"), row)
    pairs = lambda a, b: _earlier(a, b, row, threshold, any_hot, limit).select(F.col("_row").alias(row))

    def earlier_match(rest: DataFrame) -> DataFrame:
        k = with_keys(rest)
        quick = cut(_heads(k, row, threshold).select(row).distinct())
        return quick.unionByName(pairs(k.join(quick, row, "left_anti"), k))

    kept = cut(greedy_leaders(once, row, earlier_match, lambda rest, fresh: pairs(with_keys(rest), with_keys(fresh))))
    # A kept hash matches its own later copies; any other hash its first kept neighbour.
    near = _earlier(keyed, with_keys(kept), row, threshold, any_hot, limit).groupBy("_h").agg(F.min("_o").alias("_m"))
    target = (
        once.join(kept.select(F.col(row).alias("_k")), F.col(row) == F.col("_k"), "left")
        .join(near, F.col("hash") == F.col("_h"), "left")
        .select("hash", F.coalesce("_k", "_m").alias("match_row"))
    )
    return hashes.join(target, "hash").where(F.col("match_row") < F.col(row)).select(row, "match_row")


def title_duplicates(albums: DataFrame, title: str = "title", row: str = "row") -> DataFrame:
    """Albums with the first row of their title; later ones are duplicates.

    The first rows are found by a partial aggregation and joined back, so a title shared
    by very many albums is never sorted in one task.
    """
    first = albums.groupBy(F.col(title).alias("_title")).agg(F.min(row).alias("first_row"))
    same = F.col(title).eqNullSafe(F.col("_title"))
    return albums.join(first, same).drop("_title").withColumn("is_duplicate", F.col(row) != F.col("first_row"))


def album_duplicates(
    albums: DataFrame, row: str = "row", threshold: int = S.PHASH_THRESHOLD, skip_flagged: bool = True
) -> DataFrame:
    """Title pass, then cover pass over albums with no status yet and a cover hash.

    ``albums`` has row, title, status (text or NULL, set for albums fetched before) and
    hash (NULL without a cover). Flagged rows stay out of the cover pass; with
    ``skip_flagged`` off, rows that merely carry a status take part in it.
    """
    titled = cut(title_duplicates(albums))
    blank = F.coalesce(F.col("status"), F.lit("")) == "" if skip_flagged else F.lit(True)
    todo = titled.where(~F.col("is_duplicate") & blank & F.col("hash").isNotNull())
    cover = cover_duplicates(todo.select(row, "hash"), row, threshold)
    reason = F.when(F.col("is_duplicate"), F.lit("title")).when(F.col("match_row").isNotNull(), F.lit("cover"))
    return (
        titled.join(cover, row, "left")
        .withColumn("reason", reason)
        .withColumn("match_row", F.when(F.col("is_duplicate"), F.col("first_row")).otherwise(F.col("match_row")))
        .select(row, "title", "status", "reason", "match_row")
    )
