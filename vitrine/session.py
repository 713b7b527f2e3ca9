"""Session helpers: checkpoint folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a missing setting is an error, since a machine-local folder would be lost with
    its machine.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back.

    That ends its lineage, survives the loss of any executor, and works the rows out
    once, where a checkpoint would do so twice. The tables stay until the folder is
    cleared.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for written tables and streams."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def require_small(rows: int, bytes_per_row: int, limit: int, what: str) -> None:
    """Refuse to ship something to every task unless its size is within ``limit``."""
    if rows * bytes_per_row > limit:
        raise ValueError(
            f"{what}: {rows} rows of {bytes_per_row} bytes exceed the limit of {limit} bytes"
        )
