"""Held-out accuracy of the fitted models.

Toxicity is tested at two sizes: at sf0.01 only 286 texts are learned from and 113 held
out, 18 of them toxic in four languages.
"""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def rank_area(frame, label):
    rank, yes = frame.score.rank(), frame[label] == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


@pytest.mark.parametrize(("name", "label", "least", "sf"), [("op1_rule_quality", "quality", 0.95, SF), ("op3_toxicity", "toxic", 0.85, SF), ("op3_toxicity", "toxic", 0.95, "/root/testdata/sf0.1")])
def test_held_out(spark, name, label, least, sf):
    out = entry.queries()[name](spark, sf).where("held_out").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert rank_area(out.merge(labels, on="doc_id"), label) >= least


def test_model_beats_the_base_on_held_out_texts(spark):
    out = entry.queries()["op8_deleted_interpolation"](spark, SF).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()


def test_pipeline_drops_what_its_stages_find(spark):
    out = entry.queries()["pipeline"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert out.doc_id.is_unique and set(out.doc_id) < set(docs.doc_id)
    assert len(out) > 0.75 * docs.text.nunique()
