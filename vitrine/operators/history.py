"""Split history: one parent row per folder, its groups and its images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordering import latest_per_key, numbered, row_chunk


def write(
    history: DataFrame, groups: DataFrame, images: DataFrame,
    splits: DataFrame, split_groups: DataFrame, split_images: DataFrame, row: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions of the three tables after a batch of splits.

    ``splits`` holds one row per split folder and one per produced sub-folder, in ``row``
    order; the last row of a folder counts. Older rows of those folders go, and their
    groups and images with them. The child inputs refer to a parent by ``row``.
    """
    last = latest_per_key(splits, ["folder"], [F.col(row).desc()])
    top = history.agg(F.coalesce(F.max("history_id"), F.lit(0)).alias("m")).first()["m"]
    fresh = cut(
        numbered(cut(last), [], [F.col(row)], "_n", row_chunk(row))
        .withColumn("history_id", F.col("_n") + F.lit(int(top)))
        .drop("_n")
    )
    stale = history.join(fresh.select("folder"), "folder", "left_semi").select("history_id")
    ids = fresh.select(row, "history_id")
    keep = lambda t: t.join(stale, "history_id", "left_anti")
    return (
        keep(history).unionByName(fresh.select(*history.columns)),
        keep(groups).unionByName(split_groups.join(ids, row).select(*groups.columns)),
        keep(images).unionByName(split_images.join(ids, row).select(*images.columns)),
    )


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("split_time").desc(), F.col("history_id").desc())


def by_folder(history: DataFrame, folder: str) -> DataFrame:
    return history.where(F.col("folder") == folder)


def groups_of(history: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups of the given parents, by group id."""
    return history.select("history_id", "folder").join(groups, "history_id").orderBy("history_id", "group_id")


def images_of(history: DataFrame, images: DataFrame) -> DataFrame:
    return history.select("history_id", "folder").join(images, "history_id")


def set_has_features(history: DataFrame, folders: DataFrame, value: bool) -> DataFrame:
    hit = folders.select("folder").distinct().withColumn("_hit", F.lit(True))
    return history.join(hit, "folder", "left").withColumn(
        "has_features", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("has_features"))
    ).drop("_hit")


def delete(history: DataFrame, groups: DataFrame, images: DataFrame, folders: DataFrame):
    """The three tables without the given folders."""
    gone = history.join(folders.select("folder").distinct(), "folder", "left_semi").select("history_id")
    return tuple(t.join(gone, "history_id", "left_anti") for t in (history, groups, images))


def unsplit(folders: DataFrame, history: DataFrame, force: bool = False) -> DataFrame:
    """Folders still to split; all of them with ``force``."""
    return folders if force else folders.join(history.select("folder"), "folder", "left_anti")


def already_split(folders: DataFrame, history: DataFrame) -> DataFrame:
    return folders.join(history.select("folder"), "folder", "left_semi")
