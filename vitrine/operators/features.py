"""The image-feature store: lookup, merge, upsert, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .ordering import latest_per_key

KEY = ["key", "namespace"]


def since(now: Column, days: int) -> Column:
    """The oldest time that is not more than ``days`` ago; compared with the bare column it reaches the scan."""
    return now - F.make_dt_interval(F.lit(days))


def lookup(wanted: DataFrame, store: DataFrame, now: Column, days: int = S.FEATURE_TTL_DAYS) -> DataFrame:
    """Wanted images with a stored feature of the same mtime and not past ``days``.

    ``wanted`` has key, namespace and mtime; ``hit`` tells which rows need computing. Stored
    vectors are many times the size of their files, so neither side is broadcast.
    """
    s = store.select(*KEY, F.col("mtime").alias("_mtime"), "written_at", "feature")
    fresh = s.where(F.col("written_at") >= since(now, days))
    on = [wanted[c] == fresh[c] for c in KEY] + [F.col("mtime") == F.col("_mtime")]
    joined = wanted.join(fresh.hint("merge"), on, "left")
    return joined.select(
        *[wanted[c] for c in wanted.columns], "feature", F.col("feature").isNotNull().alias("hit")
    )


def merge(found: DataFrame, computed: DataFrame, order: str) -> DataFrame:
    """Cached and computed rows together, in their first order."""
    return found.unionByName(computed).orderBy(order)


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or replace on (key, namespace); the newest write stays."""
    both = store.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest_per_key(both, KEY, [F.col("_new").desc(), F.col("written_at").desc()]).drop("_new")


def clear(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """The store without one namespace, or empty."""
    return store.where(F.lit(False)) if namespace is None else store.where(F.col("namespace") != namespace)


def unexpired(store: DataFrame, now: Column, days: int = S.FEATURE_TTL_DAYS) -> DataFrame:
    """Entries not older than ``days``; exactly that age still counts."""
    return store.where(F.col("written_at") >= since(now, days))
