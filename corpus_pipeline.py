"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontaminate, near_duplicates, pii, sentencepiece_codec, toxicity
from vitrine.llm.common import table
from vitrine.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that repeat an id and text count once; rows without an id stay.
    """
    found = near_duplicates.near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    # The user's columns travel in one struct, so none can clash with a name used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    marked = rows.join(ids, F.col("id") == F.col("doc_id"), "left").where(F.coalesce("kept", F.lit(True)))
    single = marked.where(F.coalesce("rows", F.lit(1)) == 1)
    repeated = marked.where(F.col("rows") > 1).dropDuplicates(["id", "t"])
    return single.unionByName(repeated).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as their number and digests of ids and decoded text."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", tokenize),
]

#: Fitted models, tokenizers and searches over a graph are outside SQL; tests/llm/test_pipeline.py
#: holds each stage and run() against brute force on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
