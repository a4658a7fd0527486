import os

import pytest

import corpus_pipeline
from lexmill.llm import quality
from lexmill.llm.store import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, DATA).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} == ids
    placed = corpus_pipeline.STAGES[4][1](spark, mixed, DATA).collect()
    assert len(placed) == mixed.count() and len({(r.shard, r.slot) for r in placed}) == len(placed)


def test_rows_are_judged_by_themselves(spark):
    """A repeated id, equal rows, rows without an id, and a copied benchmark passage."""
    labels = table(spark, DATA, "labels")
    good = [t for (t,) in table(spark, DATA, "documents").join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").select("text").limit(6).collect()]
    item = table(spark, DATA, "benchmark").orderBy("item_id").first().text
    texts = [(5, good[0]), (5, f"{good[1]} {item}"), (7, good[2]), (7, good[2]), (None, good[3]), (None, f"{good[4]} {item}"), (9, good[2] + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, number int")
    left = lambda stage, docs: sorted(r.number for r in stage(spark, docs, DATA).collect())
    assert left(corpus_pipeline.keep_one_of_near_duplicates, docs) == [0, 1, 2, 4, 5]
    assert left(corpus_pipeline.keep_uncontaminated, docs) == [0, 2, 3, 4, 6]


def test_quality_stage_removes_what_the_classifier_rejects(spark):
    docs = table(spark, DATA, "documents")
    scored = quality.classify(docs, table(spark, DATA, "labels"))
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, DATA).collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}


def test_empty(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
