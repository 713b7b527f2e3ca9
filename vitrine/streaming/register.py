"""Registering new products batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry
from . import tables


def register(incoming: DataFrame, registered: DataFrame, row: str, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Append a stream of new products to a registry; returns (added, conflicts).

    Every batch is checked against the registry and what earlier batches added. A conflict
    never fails the batch: it goes to a table of its own.
    """
    spark = incoming.sparkSession
    fields = ", ".join(f"{n} {k}" for n, k in incoming.dtypes)
    added_path, conflict_path = f"{path}/added", f"{path}/conflicts"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = tables.get(spark, added_path, fields + ", id bigint", before=batch_id)
        known = registered.select("id", "folder").unionByName(earlier.select("id", "folder"))
        added, conflicts = registry.append(batch, known, row)
        tables.put(added, added_path, batch_id)
        tables.put(conflicts, conflict_path, batch_id)

    tables.run_available(incoming, on_batch, checkpoint)
    return tables.get(spark, added_path, fields + ", id bigint"), tables.get(spark, conflict_path, fields)


def summary(added: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Registered and refused counts."""
    both = added.select(F.lit(1).alias("ok")).unionByName(conflicts.select(F.lit(0).alias("ok")))
    return both.agg(F.count_if(F.col("ok") == 1).alias("registered"), F.count_if(F.col("ok") == 0).alias("errors"))
