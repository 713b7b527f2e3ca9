"""Tables written by micro-batches: one folder per batch, replaced when a batch is retried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def put(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one batch; writing it again replaces them."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def get(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """All batches, or those before a given one."""
    try:
        rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], schema)
    if "batch" not in rows.columns:
        return rows
    return (rows if before is None else rows.where(rows["batch"] < before)).drop("batch")


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what the source holds now, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def file_stream(spark: SparkSession, folder: str, schema, name: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, ``files_per_batch`` at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)
