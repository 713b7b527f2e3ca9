"""The product registry as a table: scan, append, delete, replace, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut
from .ordering import latest_per_key, numbered, row_chunk


def by_id(products: DataFrame) -> DataFrame:
    """All records without their vectors, ordered by id."""
    return products.drop("embedding").orderBy("id")


def find(products: DataFrame, column: str, value) -> DataFrame:
    """One record by id or by folder; the predicate reaches the file scan."""
    return products.drop("embedding").where(F.col(column) == value)


def folders(products: DataFrame) -> DataFrame:
    return products.select("folder").distinct()


def vectors(products: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, embedding) of products that have a vector, of the expected length if given."""
    out = products.where(F.col("embedding").isNotNull()).select("id", "embedding")
    return out if dim is None else V.check_dim(out, "embedding", dim)[0]


def new_folders(incoming: DataFrame, products: DataFrame, folder: str = "folder") -> DataFrame:
    """Incoming rows whose folder is not registered."""
    known = products.select(F.col("folder").alias("_known"))
    return incoming.join(known, F.col(folder) == F.col("_known"), "left_anti")


def append(incoming: DataFrame, products: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows to add, with ids after the highest one, and the conflicting rest.

    A folder is added once: rows whose folder is registered, or came earlier in the same
    batch (``row`` order), are conflicts. The first row of every folder is picked before
    the registry is looked at, so a folder repeated very often is thinned out ahead of the
    shuffle; and only row numbers, not whole records, are ranked.
    """
    first = latest_per_key(incoming.select(row, "folder"), ["folder"], [F.col(row)])
    kept = cut(new_folders(first, products).select(F.col(row).alias("_row")))
    top = products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    ids = numbered(kept, [], [F.col("_row")], "_n", row_chunk("_row")).select(
        "_row", (F.col("_n") + F.lit(int(top))).alias("id")
    )
    own = F.col(row) == F.col("_row")
    return incoming.join(ids, own).drop("_row"), incoming.join(kept, own, "left_anti")


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a parent or child table whose ``key`` is not among ``ids.id``."""
    gone = ids.select(F.col("id").alias("_gone"))
    return table.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def replace(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """Swap matched products for new ones: ``pairs`` has the new columns and ``old_id``."""
    gone = pairs.select(F.col("old_id").alias("id"))
    return delete(products, gone).unionByName(pairs.select(*products.columns))


def resolve_matches(matches: DataFrame, batch: DataFrame, products: DataFrame) -> DataFrame:
    """Product records of matched ids, batch rows first; unmatched ids drop out.

    Batch ids are negative and registry ids are not, so the two sets cannot meet.
    """
    cols = [F.col("id").alias("match_id"), "name", "store", "folder"]
    known = batch.select(*cols).unionByName(products.select(*cols))
    return matches.join(known, "match_id")


def index_audit(indexed: DataFrame, products: DataFrame) -> DataFrame:
    """Ids present on one side only, with the side they miss."""
    a = indexed.select(F.col("id").alias("a"))
    b = products.select(F.col("id").alias("b"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.where(F.col("a").isNull() | F.col("b").isNull()).select(
        F.coalesce("a", "b").alias("id"),
        F.when(F.col("a").isNull(), F.lit("index")).otherwise(F.lit("registry")).alias("missing_in"),
    )
