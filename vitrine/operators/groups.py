"""Groups of an album: members, user edits, checks, move plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .naming import unique_files, unique_names
from .ordering import numbered, row_chunk


def members(labelled: DataFrame, folder: str = "folder", idx: str = "idx", label: str = "label") -> DataFrame:
    """Dense group ids from 0 in label order, a default name, and member positions.

    Ids come from the small (folder, label) table; members stay rows, so a group of any
    size is never gathered in one place.
    """
    sizes = labelled.groupBy(folder, label).agg(F.count(F.lit(1)).alias("size"))
    ids = numbered(sizes, [folder], [F.col(label)], "_g", row_chunk(label)).select(
        folder, label, (F.col("_g") - 1).alias("group_id"), "size"
    )
    placed = numbered(labelled, [folder, label], [F.col(idx)], "_m", row_chunk(idx))
    return (
        placed.join(ids, [folder, label])
        .withColumn("member", F.col("_m") - 1)
        .withColumn("group_name", F.format_string(f"{S.GROUP_NAME_STEM}_%d", F.col("group_id") + 1))
        .drop("_m")
    )


def apply_edits(
    members_: DataFrame, moves: DataFrame | None = None, deleted: DataFrame | None = None
) -> DataFrame:
    """Groups after moving images, then deleting groups, renumbered from 0.

    ``moves`` is (folder, image_id, target_group); ``deleted`` is (folder, group_id), whose
    members go to the first group that stays. A folder keeps at least one group: when all
    are listed, its lowest one stays.
    """
    out = members_
    if moves is not None:
        m = moves.select("folder", "image_id", "target_group")
        out = out.join(m, ["folder", "image_id"], "left").withColumn(
            "group_id", F.coalesce("target_group", "group_id")
        ).drop("target_group")
    if deleted is not None:
        all_groups = members_.select("folder", "group_id")
        if moves is not None:
            all_groups = all_groups.unionByName(
                moves.select("folder", F.col("target_group").alias("group_id"))
            )
        d = deleted.select("folder", "group_id").distinct().withColumn("_gone", F.lit(True))
        flagged = all_groups.distinct().join(d, ["folder", "group_id"], "left")
        home = flagged.groupBy("folder").agg(
            F.coalesce(
                F.min(F.when(F.col("_gone").isNull(), F.col("group_id"))), F.min("group_id")
            ).alias("_home")
        )
        out = (
            out.join(d, ["folder", "group_id"], "left")
            .join(home, "folder")
            .withColumn("group_id", F.when(F.col("_gone"), F.col("_home")).otherwise(F.col("group_id")))
            .drop("_gone", "_home")
        )
    used = out.groupBy("folder", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = numbered(used, ["folder"], [F.col("group_id")], "_g", row_chunk("group_id")).select(
        "folder", "group_id", (F.col("_g") - 1).alias("new_group_id")
    )
    return out.join(ids, ["folder", "group_id"])


def next_group_id(members_: DataFrame) -> DataFrame:
    """Id a new group of each folder gets."""
    return members_.groupBy("folder").agg((F.max("group_id") + 1).alias("new_group_id"))


def violations(groups: DataFrame) -> DataFrame:
    """Folders that may not be split yet: empty groups, repeated names, blank names."""
    name = F.coalesce("group_name", F.lit(""))
    per_name = groups.groupBy("folder", name.alias("_name")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("size") == 0).alias("_empty")
    )
    return (
        per_name.groupBy("folder")
        .agg(
            F.sum("_empty").alias("empty_groups"),
            F.sum(F.col("_n") - 1).alias("repeated_names"),
            F.sum(F.when(F.col("_name") == "", F.col("_n")).otherwise(0)).alias("blank_names"),
        )
        .where("empty_groups + repeated_names + blank_names > 0")
    )


def move_plan(members_: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Source and target path of every image: one sibling folder per group.

    ``members_`` has folder_row (folder order), folder, group_id, group_name, idx, path.
    """
    from ..functions.text import sanitize_name

    groups = members_.groupBy("folder_row", "folder", "group_id", "group_name").agg(
        F.count(F.lit(1)).alias("_size")
    )
    ordered = numbered(
        groups, [], [F.col("folder_row"), F.col("group_id")], "_row", row_chunk("folder_row")
    )
    parent = F.regexp_extract("folder", r"^([\s\S]*)/[^/]*$", 1)
    own = F.substring_index("folder", "/", -1)
    wanted = ordered.withColumn("parent", parent).withColumn(
        "_wanted", sanitize_name(F.concat_ws(" ", own, "group_name"))
    )
    named = unique_names(wanted, "_row", "_wanted", "target", scope=["parent"], existing=existing)
    rows = members_.withColumn("_file", F.substring_index("path", "/", -1))
    files = unique_files(rows, "idx", "_file", ["folder", "group_id"])
    targets = named.select("folder", "group_id", "parent", "target")
    return files.join(targets, ["folder", "group_id"]).withColumn(
        "dest", F.concat_ws("/", "parent", "target", "dest_name")
    ).drop("_file")
