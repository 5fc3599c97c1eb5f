"""Nearest vectors inside groups, and the tiles of the product, against plain sorting."""

import numpy as np
from pyspark.sql import functions as F

from factloom.functions import vectors as vec
from factloom.operators import retrieve as rt


def test_tiles_keep_ties_to_the_smaller_id(monkeypatch):
    monkeypatch.setattr(vec, "TILE", 3)
    rng = np.random.default_rng(1)
    ids, rows = rng.permutation(11), vec._unit(rng.integers(-1, 2, (11, 2)).astype(float))  # few directions, many ties
    for k in (1, 4, 20):
        for earlier in (False, True):
            got = vec.best_of(ids, rows, ids, rows, k, earlier)
            for q, a in zip(ids, rows):
                others = [(-np.round(a @ b, 6), v) for v, b in zip(ids, rows) if (v < q if earlier else v != q)]
                mine = got[got["query_id"] == q]
                assert list(zip(-mine["similarity"], mine["vec_id"])) == sorted(others)[:k]


def test_rerank_of_shared_facts_equals_pairs(spark):
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 3)], i % 2) for i in range(30)], "id bigint, vector array<double>, label int")
    questions = e.select(F.col("id").alias("question_id"), "vector", F.pmod(F.col("label") + 1, F.lit(2)).alias("of"))
    facts = e.select(F.col("id").alias("fact_id"), "vector", F.col("label").alias("of"))
    pairs = facts.join(questions.select("question_id", "of"), "of").filter("fact_id < question_id").drop("of")
    rows = lambda df: sorted(map(tuple, df.select("question_id", "fact_id", F.round("similarity", 6)).collect()), key=str)
    assert rows(rt.rerank(facts, questions, 5)) == rows(rt.rerank(pairs, questions.drop("of"), 5))
