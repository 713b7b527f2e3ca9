"""Quality by a sparse rule ensemble over text statistics.

Each text is reduced to a row of statistics. A forest of shallow trees is grown on labelled
rows; every path from a root becomes a conjunctive rule; a lasso logistic regression keeps
the rules that matter; and these are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import fold, labelled, slices, texts

STATISTICS = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "space_share", "non_ascii_share",
    "distinct_share", "repeat_share", "lone_symbol_share", "symbol_end_share", "line_repeat_share", "line_length",
)
TREES = 16
DEPTH = 3
LASSO = 0.001
#: Classes of ASCII bytes: 1 upper, 2 digit, 3 space, 4 symbol other than . , ' - ", 5 beyond ASCII.
CLASSES = np.zeros(256, dtype=np.int64)
CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = 1, 2, 5
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-\""]] = 4
SYMBOL_END = tuple("!#$%&*+/<=>@\\^_`{|}~")


def measure(text: str) -> list[float]:
    """The STATISTICS of a text; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(CLASSES[raw], minlength=6) / len(raw)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log(n)), sum(map(len, words)) / n, share[1], share[2], share[4], share[3], share[5],
        len(set(words)) / n ** 0.8, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n, sum(w.endswith(SYMBOL_END) for w in words) / n,
        1 - len(set(lines)) / len(lines), float(np.log(len(text) / len(lines) + 1)),
    ]


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    src = texts(docs, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, "text"):
            out = pd.DataFrame([measure(t) for t in part["text"]], columns=list(STATISTICS))
            out.insert(0, key, part[key].to_numpy())
            yield out

    return src.mapInPandas(run, f"{key} {dict(src.dtypes)[key]}, " + ", ".join(f"{s} double" for s in STATISTICS))


def tree_rules(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """Every path from the root (inner nodes too) of a printed tree, as its conditions."""
    rules, path = [], []
    for line in debug.split("\n"):
        m = re.match(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.Ee+-]+)\)", line)
        if m:
            del path[sum(d < len(m[1]) for d, _ in path):]
            path.append((len(m[1]), (int(m[2]), m[3], float(m[4]))))
            rules.append(tuple(c for _, c in path))
    return rules


def _holds(rule: tuple[tuple[int, str, float], ...]) -> Column:
    one = lambda f, op, x: F.col(STATISTICS[f]) <= x if op == "<=" else F.col(STATISTICS[f]) > x
    return reduce(lambda a, b: a & b, (one(*c) for c in rule))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", parts: int = 4, left_out: int = 2,
        trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Column:
    """A column expression over STATISTICS: the probability of label 1.

    Learns from all labelled rows whose fold (crc32 of the key, modulo ``parts``) is not
    ``left_out``. Without rows of both labels the expression is their smoothed rate.
    """
    pool = labelled(labels, "quality").where(fold(F.col("doc_id"), parts) != left_out).withColumnRenamed("doc_id", key)
    rows = cut(stats.where(F.col(key).isNotNull()).join(pool, key).withColumn("label", F.col("label").cast("double")))
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = seen.get(1.0, 0), seen.get(0.0, 0)
    if not yes or not no:
        return F.lit((yes + 0.5) / (yes + no + 1))
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=11, minInstancesPerNode=5).fit(table)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString)))
    if not rules:
        return F.lit((yes + 0.5) / (yes + no + 1))
    flags = rows.select("label", F.array(*(_holds(r).cast("double") for r in rules)).alias("_a"))
    from pyspark.ml.functions import array_to_vector

    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(flags.select("label", array_to_vector("_a").alias("features")))
    total = F.lit(float(model.intercept))
    for rule, w in zip(rules, model.coefficients.toArray(), strict=True):
        if w:
            total += F.when(_holds(rule), F.lit(float(w))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.7, parts: int = 4, left_out: int = 2, **how) -> DataFrame:
    """key, held_out, score and predicted (score >= ``threshold``) of every row.

    Null and empty texts have all statistics zero and are scored as such; rows that repeat
    an id are scored each. Rows without an id are scored but never learned from.
    """
    stats = cut(statistics(docs, key))
    score = fit(stats, labels, key, parts, left_out, **how)
    return stats.select(key, (fold(F.col(key), parts) == left_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
