"""Collision-free names: folders of new albums, files moved into groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import sanitize_name, strip_order_prefix
from ..session import cut
from .ordering import numbered, row_chunk, sampled_chunk

_SUFFIXED = r"^([\s\S]*)_([1-9]\d{0,8})$"


def _parts(df: DataFrame, name: str, files: bool) -> DataFrame:
    """Add ``_stem`` and ``_ext``; folders have no extension."""
    ext = F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1) if files else F.lit("")
    return df.withColumn("_ext", ext).withColumn(
        "_stem", F.expr(f"substring({name}, 1, length({name}) - length(_ext))")
    )


def _slot_name(base: str, first: int) -> Column:
    return F.when(F.col("_slot") < first, F.col(base)).otherwise(
        F.concat("_stem", F.lit("_"), F.col("_slot").cast("string"), "_ext")
    )


def _counted(df: DataFrame, keys: list[str], order: str, out: str, chunk_rows: int, small: bool) -> DataFrame:
    """Row numbers per key; in chunks unless all rows together fit one."""
    if not small:
        return numbered(df, keys, [F.col(order)], out, row_chunk(order, chunk_rows))
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def _fits(df: DataFrame, keys: list[str], chunk_rows: int) -> bool:
    """Whether no key holds more than ``chunk_rows`` rows, so that each can be counted in one piece."""
    sizes = df.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return (sizes.agg(F.max("_n")).first()[0] or 0) <= chunk_rows


def _contested(rows: DataFrame, taken: DataFrame | None, scope: list[str], first: int, files: bool, chunk_rows: int) -> DataFrame | None:
    """Bases (scope, _base) whose names others may claim, or None when there are none.

    A base is contested when a taken name blocks one of its slots, or when it is a literal
    ``x_N`` beside rows of ``x``, and so is that ``x``. No name made from another base is
    taken or wanted by anyone else.
    """
    keys = [*scope, "_base"]
    number = F.regexp_extract("_stem", _SUFFIXED, 2).try_cast("bigint")
    parent = F.concat(F.regexp_extract("_stem", _SUFFIXED, 1), "_ext")
    literal = cut(rows.where(number >= first).select(*keys, parent.alias("_parent")).distinct())
    found: DataFrame | None = None
    if not literal.isEmpty():
        bases = rows.select(*scope, F.col("_base").alias("_parent")).distinct()
        pairs = cut(literal.join(bases, [*scope, "_parent"], "left_semi"))
        found = pairs.select(*keys).unionByName(pairs.select(*scope, F.col("_parent").alias("_base")))
    if taken is not None:
        blocked = _runs(taken, scope, first, files, chunk_rows, taken.count() <= chunk_rows).select(*keys)
        found = blocked if found is None else found.unionByName(blocked)
    if found is None:
        return None
    found = cut(found.distinct())
    return None if found.isEmpty() else found


def _runs(taken: DataFrame, scope: list[str], first: int, files: bool, chunk_rows: int, small: bool) -> DataFrame:
    """Runs of blocked slots per base: after ``_free`` free slots, ``_blocked`` are taken.

    A taken name blocks the plain slot of its own base and, when it ends in ``_N``, slot
    N of the base in front of that.
    """
    t = _parts(taken, "_name", files)
    number = F.regexp_extract("_stem", _SUFFIXED, 2).try_cast("bigint")
    plain = t.select(*scope, F.col("_name").alias("_base"), F.lit(first - 1).cast("bigint").alias("_b"))
    suffixed = t.where(number >= first).select(
        *scope,
        F.concat(F.regexp_extract("_stem", _SUFFIXED, 1), "_ext").alias("_base"),
        number.alias("_b"),
    )
    blocked = plain.unionByName(suffixed).distinct()
    ranked = _counted(blocked, [*scope, "_base"], "_b", "_i", chunk_rows, small)
    runs = ranked.groupBy(
        *scope, "_base", (F.col("_b") - F.lit(first - 1) - (F.col("_i") - 1)).alias("_free")
    ).agg(F.max("_i").alias("_blocked"))
    w = Window.partitionBy(*scope, "_base").orderBy("_free")
    return runs.withColumn("_until", F.coalesce(F.lead("_free").over(w), F.lit(2**62)))


def unique_names(
    df: DataFrame,
    row: str,
    base: str,
    out: str,
    scope: Sequence[str] = (),
    existing: DataFrame | None = None,
    first: int = 2,
    files: bool = False,
    max_suffix: int | None = S.MAX_NAME_SUFFIX,
    chunk_rows: int = S.CHUNK_ROWS,
) -> DataFrame:
    """Give every row, in ``row`` order, the first name not taken before it.

    Candidates are ``base``, ``base_2``, ``base_3``… within ``scope`` (for files the
    number goes before the extension). ``existing`` holds the scope columns and the names
    already taken, in a column named like ``out``.

    Rows of one base are counted in parallel and offered consecutive free numbers. Only a
    literal ``x_2`` can compete with a generated one, so after each round the offers that
    no earlier waiting row could claim are final, and the few others are offered again.
    The earliest waiting row is settled each time, so the rounds end without a limit. A row
    that would need a number above ``max_suffix`` has a NULL name; the others keep theirs.
    Bases that nobody else can claim a name of take no part in the rounds: one count per base
    names their rows.
    """
    scope = list(scope)
    keys = [*scope, "_base"]
    cols = df.columns
    rows = cut(_parts(df.withColumn("_base", F.col(base)), "_base", files))
    taken = None if existing is None else cut(existing.select(*scope, F.col(out).alias("_name")))
    contested = _contested(rows, taken, scope, first, files, chunk_rows)
    free = rows if contested is None else cut(rows.join(contested, keys, "left_anti"))
    done = (
        _counted(free, keys, row, "_k", chunk_rows, _fits(free, keys, chunk_rows))
        .withColumn("_slot", F.lit(first - 2) + F.col("_k"))
        .select(*cols, _slot_name("_base", first).alias(out), "_slot")
    )
    waiting = None if contested is None else cut(rows.join(contested, keys, "left_semi"))
    while waiting is not None:
        ranked = _counted(waiting, keys, row, "_k", chunk_rows, _fits(waiting, keys, chunk_rows))
        if taken is None:
            offers = ranked.withColumn("_blocked", F.lit(0).cast("bigint"))
        else:
            few = taken.count() <= chunk_rows
            r, b = ranked.alias("r"), _runs(taken, scope, first, files, chunk_rows, few).alias("b")
            same = F.lit(True)
            for c in keys:
                same = same & (F.col(f"r.{c}") == F.col(f"b.{c}"))
            between = (F.col("r._k") - 1 >= F.col("b._free")) & (F.col("r._k") - 1 < F.col("b._until"))
            offers = r.join(b, same & between, "left").select(
                "r.*", F.coalesce("b._blocked", F.lit(0)).alias("_blocked")
            )
        offers = cut(
            offers.withColumn("_slot", F.lit(first - 2) + F.col("_k") + F.col("_blocked"))
            .withColumn("_name", _slot_name("_base", first))
            .drop("_k", "_blocked")
        )
        # The earliest waiting row of each base, and of each claimed name.
        heads = offers.groupBy(*keys).agg(F.min(row).alias("_head"))
        claims = offers.groupBy(*scope, "_name").agg(F.min(row).alias("_claim"))
        number = F.regexp_extract("_stem", _SUFFIXED, 2).try_cast("bigint")
        parents = heads.select(*scope, F.col("_base").alias("_parent"), F.col("_head").alias("_parent_head"))
        judged = (
            offers.withColumn(
                "_parent",
                F.when(
                    (F.col("_slot") < first) & (number >= first),
                    F.concat(F.regexp_extract("_stem", _SUFFIXED, 1), "_ext"),
                ),
            )
            .join(claims, [*scope, "_name"])
            .join(parents, [*scope, "_parent"], "left")
            .withColumn(
                "_ok",
                (F.col("_claim") == F.col(row))
                & (F.col("_parent_head").isNull() | (F.col("_parent_head") >= F.col(row))),
            )
        )
        stops = judged.where(~F.col("_ok")).groupBy(*keys).agg(F.min(row).alias("_stop"))
        judged = cut(
            judged.join(stops, keys, "left").withColumn(
                "_ok", F.col("_stop").isNull() | (F.col(row) < F.col("_stop"))
            )
        )
        final = judged.where("_ok")
        named = final.select(*cols, F.col("_name").alias(out), "_slot")
        done = done.unionByName(named)
        held = final.select(*scope, "_name")
        taken = held if taken is None else taken.unionByName(held)
        waiting = judged.where("NOT _ok").select(*cols, "_base", "_stem", "_ext")
        if waiting.isEmpty():
            break
    if max_suffix is not None:
        done = done.withColumn(out, F.when(F.col("_slot") <= max_suffix, F.col(out)))
    return done.drop("_slot")


def unique_folders(
    albums: DataFrame, row: str, title: str, out: str = "folder_name", existing: DataFrame | None = None, **kw
) -> DataFrame:
    """Clean folder name per album, numbered from 2 when taken."""
    named = albums.withColumn("_clean", sanitize_name(F.col(title)))
    return unique_names(named, row, "_clean", out, existing=existing, **kw).drop("_clean")


def unique_files(files: DataFrame, row: str, name: str, scope: Sequence[str], out: str = "dest_name", **kw) -> DataFrame:
    """File name per moved image, numbered from 1 inside its target folder when taken."""
    return unique_names(
        files, row, name, out, scope=scope, first=1, files=True, max_suffix=None, **kw
    )


def reorder_main(files: DataFrame, folder: str, path: str, is_main: Column) -> DataFrame:
    """Names ``001_…`` with the main image first and the others in path order."""
    chunk = F.when(F.col("_main"), F.lit(-1)).otherwise(sampled_chunk(files, path))
    ranked = numbered(
        files.withColumn("_main", is_main), [folder], [F.col("_main").desc(), F.col(path)], "position", chunk
    )
    name = strip_order_prefix(F.substring_index(F.col(path), "/", -1))
    return ranked.withColumn("new_name", F.format_string("%03d_%s", "position", name)).drop("_main")
