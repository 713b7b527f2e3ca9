"""Albums to variant groups, and product folders to listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import cluster, dedup, groups, history, listing, zero_shot
from ..session import cut


def split(images: DataFrame, split_history: DataFrame, threshold: float = S.CLUSTER_DEFAULT, force: bool = False, labels: dict | None = None) -> DataFrame:
    """Images (folder, idx, path, v) with the variant group each belongs to.

    With ``labels`` (see ``zero_shot.label_table``) groups are named from their first
    images, else by number.
    """
    todo = history.unsplit(images, split_history, force)
    found = cluster.cluster(todo.select("folder", "idx", "v"), threshold)
    out = groups.members(todo.join(found.select("folder", "idx", "label"), ["folder", "idx"]))
    if labels is None:
        return out.drop("v")
    gid = F.struct("folder", "group_id")
    head = out.withColumn("_g", F.xxhash64(gid))
    named = zero_shot.names(dedup.first_n_vectors(head, "_g", "member"), labels, "_g").select("_g", "name")
    return head.join(named, "_g").withColumn("group_name", F.col("name")).drop("_g", "name", "v")


def finish(
    members: DataFrame, folders: DataFrame, split_time: Column,
    past: DataFrame, past_groups: DataFrame, past_images: DataFrame, existing: DataFrame | None = None,
) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """The move plan of split albums, and the three history tables with them recorded.

    ``members`` comes from ``split`` (after edits, if any), ``folders`` is (folder_row,
    folder), ``existing`` the sub-folders already there (parent, target). An album is
    recorded with its groups and the old paths of its images, each new sub-folder as a
    split of one group.
    """
    plan = cut(groups.move_plan(members.join(folders.select("folder_row", "folder"), "folder"), existing))
    parts = cut(
        plan.groupBy("folder_row", "folder", "group_id", "group_name", "parent", "target")
        .agg(F.count(F.lit(1)).cast("int").alias("image_count"))
    )
    # Rows of one album are consecutive: the album first, then its groups.
    stride = (parts.agg(F.max("group_id")).first()[0] or 0) + 2
    row = F.col("folder_row") * stride
    whole = parts.groupBy("folder_row", "folder").agg(F.count(F.lit(1)).alias("group_count"), F.sum("image_count").cast("int").alias("image_count"))
    whole = whole.select(row.alias("row"), "folder", "group_count", "image_count")
    subs = parts.select(
        (row + F.col("group_id") + 1).alias("row"), F.concat_ws("/", "parent", "target").alias("folder"),
        F.lit(1).cast("bigint").alias("group_count"), "image_count",
    )
    splits = whole.unionByName(subs).withColumn("split_time", split_time).withColumn("has_features", F.lit(False))
    named = parts.select(row.alias("row"), "group_id", "group_name")
    images = plan.select(row.alias("row"), "group_id", F.col("path").alias("file_path"))
    return plan, history.write(past, past_groups, past_images, splits, named, images, "row")


def listings(folders: DataFrame, files: DataFrame, vectors: DataFrame, labels: dict, lo: float, hi: float | None = None) -> DataFrame:
    """Listing rows: images, category, title and price per folder (row, folder).

    ``files`` is (folder, path) and ``vectors`` (folder, path, v). Empty folders come
    first, with a placeholder title.
    """
    shots = listing.listing_images(files)
    heads = dedup.first_n_vectors(vectors, "folder", "path")
    classed = zero_shot.categories(heads, labels, "folder").select("folder", "category")
    none = F.array().cast("array<string>")
    return (
        folders.join(shots, "folder", "left").join(classed, "folder", "left")
        .withColumn("empty", F.col("main_images").isNull())
        .withColumn(
            "title",
            F.when(F.col("empty"), F.lit(S.EMPTY_FOLDER_TITLE)).otherwise(
                listing.compose_title(F.col("row"), F.coalesce("category", F.lit(S.DEFAULT_CATEGORY)))
            ),
        )
        .withColumn("price", F.when(F.col("empty"), F.lit(0.0)).otherwise(listing.price(F.col("row"), lo, hi)))
        .withColumn("main_images", F.coalesce("main_images", none))
        .withColumn("detail_images", F.coalesce("detail_images", none))
        .orderBy(F.col("empty").desc(), "row")
    )
