"""Vector functions, similarity joins and the dedup decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine import settings as S
from vitrine.functions import vectors as V
from vitrine.operators import dedup, similarity, summaries
from vitrine.operators.ordering import top_per_key

from . import views as W
from .registry import query
from .views import with_views

_TOP = """
SELECT * FROM (
  SELECT q.qid, r.id, round(list_inner_product(q.v, r.v), 9) AS s,
    row_number() OVER (PARTITION BY q.qid ORDER BY round(list_inner_product(q.v, r.v), 9) DESC, r.id) AS rank
  FROM cand q CROSS JOIN vecs r) WHERE rank <= 5
"""
W.SQL["top"] = _TOP
W.SQL["decided"] = """
SELECT qid, CASE WHEN m >= 0.92 THEN 'duplicate' WHEN m >= 0.85 THEN 'review' ELSE 'new' END AS status,
  best_id, round(m, 6) AS best_sim, CASE WHEN m >= 0.85 THEN above ELSE n END AS n_matches
FROM (SELECT qid, max(s) AS m, min(id) FILTER (rank = 1) AS best_id, count(*) AS n, count(*) FILTER (s >= 0.85) AS above
  FROM top GROUP BY qid)
"""


def registry_items(spark, sf):
    return W.vecs(spark, sf).select("id", "v")


def decided(spark, sf):
    q = W.cand(spark, sf)
    return dedup.decide(q.drop("v"), similarity.top_k(q, registry_items(spark, sf)))


@query("join_vector_topk", with_views("vecs cand top", "SELECT qid, id, round(s, 6) AS sim, rank FROM top"))
def _(spark, sf):
    out = similarity.top_k(W.cand(spark, sf), registry_items(spark, sf))
    return out.select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query("dedup_decide", with_views("vecs cand top decided", "SELECT * FROM decided"))
def _(spark, sf):
    return decided(spark, sf).select(
        "qid", "status", "best_id", F.round("best_sim", 6).alias("best_sim"), F.size("matches").alias("n_matches")
    )


@query("agg_dedup_summary", with_views("vecs cand top decided", """
SELECT count(*) AS total, count(*) FILTER (status = 'duplicate') AS duplicate,
  count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'new') AS "new", 0 AS error FROM decided"""))
def _(spark, sf):
    return summaries.dedup_summary(decided(spark, sf).withColumn("error", F.lit(None).cast("string")))
