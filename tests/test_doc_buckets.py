"""What is kept in buckets by document is grouped and joined by document without a shuffle."""

import pytest
from test_pairs_in_place import rows, shuffles

from factloom.operators import docmodel as dm
from factloom.operators import evaluate as ev
from factloom.operators import evidence as evi
from factloom.plans.adapters import Tables
from factloom.session import stored_by


@pytest.fixture
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_document_operators_shuffle_nothing(tables):
    ments, sents = tables.oc_mentions, tables.oc_sentence_rows()
    for df in (dm.mentions(tables.docs()), dm.canonical(ments), dm.entity_sents(ments), dm.edge_category(ments), dm.candidate_pairs(ments, "sents"),
               dm.mention_spans(ments, dm.word_offsets(sents), 24), evi.cooccurrence(tables.oc_label_rows(), ments)):
        assert shuffles(df) == 0 and df.count() > 0


def test_buckets_hold_the_same_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (7, None)], "doc bigint, x int")
    kept = stored_by(df, "doc", 3, "few")
    assert rows(kept) == rows(df)
    assert shuffles(kept.join(kept.groupBy("doc", "x").count(), ["doc", "x"])) == 0


def test_blending_reads_its_weights_once(spark):
    weights = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 1, 2, 0.0), (2, 0, 0, 2.0)], "doc int, sent_id int, position int, weight double")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 3), (2, 0, 0, 1)], "doc int, sent_id int, start int, end int")
    got = evi.blend_evidence(weights, spans, ["doc"], 0.5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 5  # 2 of weights, 3 of spans at most
    want = {(1, 0): 0.375, (1, 1): 0.625, (1, 2): 0.0, (2, 0): 1.0}
    assert {(r.doc, r.position): round(r.weight, 9) for r in got.collect()} == want


def test_frequency_bands_join_relations_not_triples(spark):
    preds = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 0, "b"), (2, 0, 1, None)], "doc int, h int, t int, r string")
    gold = spark.createDataFrame([(1, 0, 1, "a"), (2, 0, 1, "a")], "doc int, h int, t int, r string")
    counts = spark.createDataFrame([("a", 9), ("b", 1)], "r string, n bigint")
    got = ev.score_by_frequency(preds, gold, counts, 0.5)
    assert {(r.band, r.n_pred, r.n_gold, r.n_correct) for r in got.collect()} == {("frequent", 1, 2, 1), ("long_tail", 2, 0, 0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("FullOuter") and "Aggregate [r" in plan[plan.index("LeftOuter"):plan.index("FullOuter")]
