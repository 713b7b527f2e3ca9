"""Display states, chosen by precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S

# Words shown for each state.
DEDUP_WORDS = {"registered": "已入库", "error": "X", S.DUPLICATE: "重复", S.REVIEW: "待审", S.NEW: "新"}
SPLIT_WORDS = {"error": "X", "split": "!", "ok": "OK"}
PROCESS_WORDS = {"errors": "!", "empty": "—", "ok": "OK"}


def dedup_label(deleted: Column, registered: Column, error: Column, status: Column) -> Column:
    """Deletion note, then registered, error, duplicate, review, new."""
    return (
        F.when(deleted.isNotNull(), deleted)
        .when(registered, F.lit(DEDUP_WORDS["registered"]))
        .when(F.coalesce(error, F.lit("")) != "", F.lit(DEDUP_WORDS["error"]))
        .when(status == S.DUPLICATE, F.lit(DEDUP_WORDS[S.DUPLICATE]))
        .when(status == S.REVIEW, F.lit(DEDUP_WORDS[S.REVIEW]))
        .otherwise(F.lit(DEDUP_WORDS[S.NEW]))
    )


def split_label(error: Column, group_count: Column) -> Column:
    return (
        F.when(F.coalesce(error, F.lit("")) != "", F.lit(SPLIT_WORDS["error"]))
        .when(group_count > 1, F.lit(SPLIT_WORDS["split"]))
        .otherwise(F.lit(SPLIT_WORDS["ok"]))
    )


def process_label(failed: Column, total: Column) -> Column:
    return (
        F.when(failed > 0, F.lit(PROCESS_WORDS["errors"]))
        .when(total == 0, F.lit(PROCESS_WORDS["empty"]))
        .otherwise(F.lit(PROCESS_WORDS["ok"]))
    )
