"""Pair operators that gather a document's entities: the same rows as by joins, and only mentions travel."""

from pyspark.sql import functions as F

from factloom.operators import docmodel as dm
from factloom.operators import postproc as pp


def rows(df):
    return sorted(map(str, df.collect()))


def shuffles(df):
    """Of a fresh plan, with every join a shuffle."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("Exchange hashpartitioning")


def test_pair_distance_shuffles_no_pairs(docs):
    ments = dm.mentions(docs)
    plain = dm.candidate_pairs(ments)
    near, joined = dm.pair_distance(dm.candidate_pairs(ments, "sents"), ments), dm.pair_distance(plain, ments)
    assert rows(near) == rows(joined) and near.count() > 0
    assert shuffles(near) == shuffles(plain) < shuffles(joined)


def test_doc_graph_by_spans_equals_join(docs):
    ments, sents = dm.mentions(docs), dm.sentences(docs).select("doc", "sent_id")
    by_span = dm.doc_graph(dm.candidate_pairs(ments, "sents", "spans"), ments, sents)
    assert rows(by_span) == rows(dm.doc_graph(dm.candidate_pairs(ments), ments, sents))
    assert shuffles(by_span) < shuffles(dm.doc_graph(dm.candidate_pairs(ments), ments, sents))


def test_decoding_a_pairs_array_equals_class_rows(spark):
    whole = spark.createDataFrame([(1, 0, 1, [1.0, 3.0, 3.0, 2.0]), (1, 1, 0, [5.0, 5.0, 1.0, 0.0]), (2, 0, 1, [0.0, 1.0, -1.0, 4.0]), (2, 1, 0, [2.0, 2.5, 2.5, 9.0])],
                                  "doc bigint, h int, t int, logits array<double>")
    long = whole.select("doc", "h", "t", F.posexplode("logits").alias("class_id", "logit"))
    for k in (None, 1, 2):
        for na in (False, True):
            packed = pp.decode_adaptive(whole, k, na)
            assert rows(packed) == rows(pp.decode_adaptive(long, k, na))
            assert shuffles(packed) == 0
        assert rows(pp.decode_sigmoid(whole, 0.6, k)) == rows(pp.decode_sigmoid(long, 0.6, k))
