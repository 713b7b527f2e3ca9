"""Greedy leaders: in row order, keep an item unless an earlier kept item matches it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import cut


def greedy_leaders(
    items: DataFrame,
    row: str,
    earlier_match: Callable[[DataFrame], DataFrame],
    matched_by: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Rows that a one-by-one pass would keep.

    ``earlier_match(rest)`` gives the rows with an earlier match among ``rest``;
    ``matched_by(rest, kept)`` the rows with an earlier match among ``kept``. A row without
    an undecided earlier match is kept; rows matched by it are then settled too. Both
    steps report rows, never pairs, so a large group of copies costs one row per member.
    The first undecided row is always kept, so every round makes progress and the loop ends.
    """
    rest = cut(items)
    kept: DataFrame | None = None
    while True:
        blocked = earlier_match(rest).select(row).distinct()
        flagged = cut(_flag(rest, blocked, row))
        fresh = flagged.where("NOT _hit").drop("_hit")
        kept = fresh if kept is None else kept.unionByName(fresh)
        open_ = flagged.where("_hit").drop("_hit")
        if open_.isEmpty():
            return kept
        settled = matched_by(open_, fresh).select(row).distinct()
        rest = cut(_flag(open_, settled, row).where("NOT _hit").drop("_hit"))
        if rest.isEmpty():
            return kept


def _flag(df: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    from pyspark.sql import functions as F

    hits = rows.withColumn("_hit", F.lit(True))
    return df.join(hits, row, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
