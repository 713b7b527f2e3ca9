"""Image files and folders on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_image_content, is_image_name


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, modificationTime and content of files; unread content is not loaded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path)


def image_files(files: DataFrame, ordered: bool = True) -> DataFrame:
    """Files with an image extension, by path."""
    kept = files.where(is_image_name(F.col("path")))
    return kept.orderBy("path") if ordered else kept


def image_folders(files: DataFrame, base: str | None = None) -> DataFrame:
    """Folders directly under ``base`` holding at least one image, with their image count.

    Without ``base`` the folder is whatever stands before the last slash.
    """
    folder = F.regexp_extract("path", r"^([\s\S]*)/[^/]*$", 1)
    found = image_files(files, ordered=False).withColumn("folder", folder)
    if base is not None:
        depth = F.regexp_extract("folder", r"([^/]*)$", 1)
        found = found.where(F.col("folder") == F.concat(F.lit(base.rstrip("/") + "/"), depth))
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("image_count")).orderBy("folder")


def valid_images(files: DataFrame) -> DataFrame:
    """Files whose first bytes are those of an image."""
    return files.where(is_image_content(F.col("content")))


def pixels(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images; corrupt files come back with height -1 unless dropped."""
    reader = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower())
    return reader.option("recursiveFileLookup", "true").load(path)
