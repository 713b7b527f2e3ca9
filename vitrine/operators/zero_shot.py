"""Classification against label vectors, and names built from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from .blocks import matrix, similarities

FLOORS = {"category": S.CATEGORY_FLOOR, "colour": S.COLOUR_FLOOR, "style": S.STYLE_FLOOR}


def label_table(labels: DataFrame) -> dict[str, tuple[list[str], np.ndarray]]:
    """(kind, label, pos, v) rows as one matrix per kind; refused when not a small set."""
    rows = labels.select("kind", "label", "pos", "v").limit(S.MAX_LABELS + 1).collect()
    if len(rows) > S.MAX_LABELS:
        raise ValueError(f"more than {S.MAX_LABELS} labels")
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        mine = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["pos"])
        out[kind] = ([r["label"] for r in mine], np.asarray([r["v"] for r in mine], dtype=np.float64))
    return out


def best_labels(vectors: DataFrame, labels: dict, key: str, v: str = "vector") -> DataFrame:
    """Most similar label of every kind, first in order on ties: (key, kind, label, sim).

    Vectors of (almost) no length match nothing and give no row.
    """
    kind = dict(vectors.dtypes)[key]
    shared = vectors.sparkSession.sparkContext.broadcast(labels)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows == 0:
                continue
            m = matrix(t[v])
            solid = np.linalg.norm(m, axis=1) >= 1e-8
            keys = t[key].filter(pa.array(solid))
            for name, (words, lv) in shared.value.items():
                sims = similarities(m[solid], lv)
                best = sims.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [keys.combine_chunks(), pa.array([name] * len(best), pa.string()),
                     pa.array([words[i] for i in best], pa.string()),
                     pa.array(sims[np.arange(len(best)), best], pa.float64())],
                    names=[key, "kind", "label", "sim"],
                )

    return vectors.select(key, v).mapInArrow(run, f"{key} {kind}, kind string, label string, sim double")


def categories(vectors: DataFrame, labels: dict, key: str, v: str = "vector") -> DataFrame:
    """Best category per vector, without a floor; the default where nothing matches."""
    found = best_labels(vectors, {"category": labels["category"]}, key, v).select(key, "label", "sim")
    return vectors.select(key).join(found, key, "left").withColumn(
        "category", F.coalesce("label", F.lit(S.DEFAULT_CATEGORY))
    ).drop("label")


def names(vectors: DataFrame, labels: dict, key: str, v: str = "vector") -> DataFrame:
    """Category, colour and style that are strictly above their floors, joined by spaces."""
    found = best_labels(vectors, labels, key, v)
    part: dict[str, Column] = {
        k: F.max(F.when((F.col("kind") == k) & (F.col("sim") > f), F.col("label"))).alias(k)
        for k, f in FLOORS.items()
    }
    wide = found.groupBy(key).agg(*part.values())
    text = F.concat_ws(" ", *FLOORS)
    return vectors.select(key).join(wide, key, "left").withColumn(
        "name", F.when(text == "", F.lit(S.UNNAMED)).otherwise(text)
    )
