"""What a task, a worker or the driver holds stays bounded where the input grows."""

import factloom.plans.all_queries  # noqa: F401  (registers the queries)
import numpy as np
from pyspark.sql import functions as F

from factloom.functions import vectors
from factloom.operators import evaluate as ev
from factloom.operators import link
from factloom.plans.adapters import Tables
from factloom.plans.registry import QUERIES


def test_a_query_travels_once_to_each_group_of_blocks(spark):
    rng = np.random.default_rng(2)
    n_blocks, n_queries = 40, 50
    blocks = vectors.Blocks(np.eye(4), np.arange(n_blocks) * 8, np.zeros(n_blocks, int), np.full(n_blocks, 100), np.zeros(n_blocks), np.full(n_blocks, np.pi))
    asked = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3, -2.0) for i in range(n_queries)], "query_id long, vector array<double>, part long, kth double")
    keys = vectors._in_groups(blocks.rows, 1_000)
    assert len(set(keys)) == 4
    first = vectors._visits(asked, blocks, blocks.block, 3, again=False).select("query_id", F.explode("wanted").alias("block"))
    rows = vectors._visits(asked, blocks, keys, 3, again=True).collect()
    assert len(rows) == n_queries * 4  # was a row, with its vector, for each of the 40 blocks
    again = {(r["query_id"], b) for r in rows for b in r["wanted"]}
    before = {(r["query_id"], r["block"]) for r in first.collect()}
    assert not again & before and len(again | before) == n_queries * n_blocks


def test_exploded_texts_are_never_broadcast(spark):
    mentions = spark.createDataFrame([("Cutsomer 1",), ("Ada",)], "mention string")
    names = spark.createDataFrame([("Customer 1",), ("Ada",)], "name string")
    for pairs in (link.struck_pairs(mentions, names, 2), link.fuzzy_pairs(mentions, names, 80.0)):
        assert {(r["mention"], r["name"]) for r in pairs.filter("ratio >= 80").collect()} == {("Cutsomer 1", "Customer 1"), ("Ada", "Ada")}
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan  # 172 parts of a text of 18 letters went through the driver


def test_rows_unfolded_from_documents_are_not_broadcast(spark):
    for name in ("m5_denoise", "m9_best_threshold"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [doc" in plan and "BroadcastHashJoin [doc" not in plan  # Spark took labels to be as small as the documents' files
    assert Tables(spark, "/root/testdata/sf0.001").BUCKET_LINES <= 32768  # a task sorts the pairs of these lines


def test_pairs_meet_facts_only_where_both_names_are_known(spark):
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 0, 2), (1, 2, 0)], "doc int, h int, t int")
    ments = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (1, 2, None), (9, 0, "a")], "doc int, entity int, name string")
    facts = spark.createDataFrame([("b", "c", "r"), ("x", "a", "r"), (None, None, "r")], "head_name string, tail_name string, r string")
    gold = spark.createDataFrame([(1, 0, 1, "r"), (1, 1, 0, "r")], "doc int, h int, t int, r string")
    got = ev.distant_audit(pairs, ments, facts, gold)
    assert {(r["outcome"], r["n"]) for r in got.collect()} == {("caught", 1), ("missed", 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_a_pair_of_texts_is_compared_once(spark):
    mentions = spark.createDataFrame([("Cutsomer 1",), ("Ada",), ("1234567",)], "mention string")
    names = spark.createDataFrame([("Customer 1",), ("Ada",), ("no 1234567 of many",)], "name string")
    for pairs in (link.struck_pairs(mentions, names, 2), link.fuzzy_pairs(mentions, names, 80.0)):
        found = pairs.filter("ratio >= 80")
        assert {(r["mention"], r["name"]) for r in found.collect()} == {("Cutsomer 1", "Customer 1"), ("Ada", "Ada")}
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # once for each meeting of a pair, and once more
    plan = link.struck_pairs(mentions, names, 2)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython"):plan.index("SortMergeJoin")]
    plan = link.fuzzy_pairs(mentions, names, 80.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and ", lb#" in plan[plan.index("SortMergeJoin [key"):].split("]")[0]  # short mentions met all long names first
