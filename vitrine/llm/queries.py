"""The registered queries of the operators: each over its whole table, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bit_codes, conversation_repair, decontaminate, interpolated_lm, main_text, near_duplicates, periodic_runs, pii, rule_quality, secret_scan, sentencepiece_codec, toxicity, warc
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents")))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        bit_codes.search(index, index.where("vec_id % 100 = 0"), centre, bits)
        for index, centre, bits in bit_codes.build_all(table(spark, sf_dir, "embeddings"))
    ]
    return reduce(DataFrame.unionByName, found)



ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT p.page_id, p.n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.x, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> m.top THEN m.top END AS refers_to
FROM p JOIN m USING (h)
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op5_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id AS id, 0 AS kind, coalesce(text, '') AS t FROM documents UNION ALL
  SELECT item_id, 1, coalesce(text, '') FROM benchmark),
w AS (
  SELECT id, kind, list_filter(string_split_regex(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
s AS (
  SELECT DISTINCT id, kind, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 1 GROUP BY id),
x AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared
      FROM s a JOIN s b ON a.s = b.s AND a.kind = 0 AND b.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM x JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(table(spark, sf_dir, "documents"))


@query
def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find(periodic_runs.repeated(table(spark, sf_dir, "documents"))))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    turns = conversation_repair.damaged(original)
    return conversation_repair.report(turns, conversation_repair.plan(turns, original))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))
