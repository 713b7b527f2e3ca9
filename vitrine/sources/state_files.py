"""JSON state files to tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_ENTRY = (
    "struct<album_id:string,username:string,title:string,folder:string,image_count:bigint,"
    "downloaded:bigint,status:string,updated_at:string>"
)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``raw``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))


def load_map(raw: DataFrame, value_type: str, text: str = "raw") -> DataFrame:
    """(key, value) entries of JSON objects; a text that is not one gives no rows."""
    parsed = F.from_json(text, f"map<string,{value_type}>", {"mode": "PERMISSIVE"})
    keep = [c for c in raw.columns if c != text]
    return raw.select(*keep, F.explode(parsed).alias("key", "value"))


def load_log(raw: DataFrame) -> DataFrame:
    """Download log: one row per ``user:album`` key."""
    return load_map(raw, LOG_ENTRY).select("key", "value.*")


def load_marks(raw: DataFrame) -> DataFrame:
    """Upload marks: (parent_dir, folder, marked_at)."""
    return (
        load_map(raw, "map<string,string>")
        .select(F.col("key").alias("parent_dir"), F.explode("value").alias("folder", "marked_at"))
        .withColumn("marked_at", F.col("marked_at").try_cast("timestamp"))
    )


def load_history(raw: DataFrame) -> DataFrame:
    """URL history: a JSON list, newest first."""
    parsed = F.from_json("raw", "array<string>")
    return raw.select(F.posexplode(parsed).alias("pos", "url"))


def save(entries: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the state as a new version of its folder."""
    entries.write.mode("overwrite").format(fmt).save(path)
