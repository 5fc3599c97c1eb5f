"""What a document's row holds is made once and looked up there: the same rows as the SQL and as class rows, in plans without the joins and second readings of before."""

import duckdb
import factloom.plans.all_queries  # noqa: F401  (registers the queries)
from oracle_check import rows_of
from pyspark.sql import functions as F
from test_pairs_in_place import rows

from factloom.operators import docmodel as dm
from factloom.operators import evidence as evi
from factloom.operators import postproc as pp
from factloom.plans.adapters import Tables, with_views
from factloom.plans.registry import QUERIES

GIVEN = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_numbered_by_one_sort(spark, tmp_path):
    lines = [(o, n, p, s, q, 1.0, 0.1, x, f, "O", "2000-01-01") for o, n, p, s, q, x, f in [
        (7, 3, 10, 1, 5.0, 0.0, "A"), (7, 3, 10, 1, 5.0, 0.0, "A"), (7, 3, 9, 2, 50.0, 0.08, "R"), (7, 1, 10, 2, 1.0, 0.0, "A"), (7, 4, 9, 1, 2.0, 0.0, None),
        (None, 1, 9, 1, 1.0, 0.0, "A"), (-4, 2, -9, 11, 1.0, 0.0, "N"), (-4, 5, 100, 1, 1.0, 0.0, "R"), (-4, 5, 10, 11, 1.0, 0.0, "A"), (8, 1, 777, 1, 1.0, 0.0, "A")]]
    named = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    named(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
          "l_returnflag string, l_linestatus string, l_shipdate string", "lineitem")
    named([(9, "red cup"), (10, "blue cup"), (100, "old cup"), (-9, "no cup")], "p_partkey bigint, p_name string", "part")
    named([(1, "S1"), (2, "S2"), (11, "S11")], "s_suppkey bigint, s_name string", "supplier")
    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    tables = Tables(spark, str(tmp_path))
    for view in ("oc_mentions", "oc_labels"):
        got = getattr(tables, view)
        want = con.execute(with_views(f"SELECT * FROM {view} WHERE doc IS NOT NULL"))
        assert rows_of(got.columns, got.filter("doc IS NOT NULL").collect()) == rows_of([c[0] for c in want.description], want.fetchall())
    assert tables.oc_mentions.filter("doc IS NULL").count() == 3
    assert "Window" not in plan_of(tables._oc_docs())  # there were eleven, each with its own copy of the lines


def test_marked_words_are_made_once(spark):
    df = QUERIES["d10_marked_spans"](spark, GIVEN)
    assert plan_of(df).count("oc_docs") <= 3  # of sentences, marks and mentions; a word's place had been joined and read again at each step


def test_marks_outside_a_sentence_take_no_place(spark):
    sents = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, []), (1, 2, ["c"]), (None, 0, ["x"])], "doc int, sent_id int, tokens array<string>")
    ments = spark.createDataFrame([(1, 0, 0, 0, 0, 2), (1, 0, 1, 0, 0, 1), (1, 1, 0, 0, 1, 9), (1, 2, 0, 2, 0, 1), (1, 3, 0, 5, 0, 1)],
                                  "doc int, entity int, mention int, sent_id int, start_w int, end_w int")
    marked = dm.marked_tokens(sents, ments)
    assert [tuple(r) for r in marked.orderBy("sent_id", "w").select("sent_id", "piece", "width", "position").collect()] == [
        (0, "* a *", 3, 0), (0, "* b *", 3, 3), (2, "* c *", 3, 6)]
    assert {tuple(r) for r in dm.marked_spans(marked, ments).collect()} == {(1, 0, 0, 0, 6), (1, 0, 1, 0, 3), (1, 2, 0, 6, 9)}


def test_only_pairs_with_a_decoded_class_are_unfolded(spark):
    for name in ("m2_decode_sigmoid", "m3_confidence"):
        plan = plan_of(QUERIES[name](spark, GIVEN))
        assert "array_max(" in plan[plan.index("Generate posexplode"):]  # every pair was, with all its classes


def test_fusing_arrays_equals_class_rows(spark):
    schema = "doc bigint, h int, t int, logits array<double>"
    full = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [3.0, None]), (1, 0, 4, [0.0, 1.0]), (2, 0, 1, [5.0, 6.0])], schema)
    sub = spark.createDataFrame([(1, 0, 1, [0.25, None]), (1, 1, 0, [2.0, 1.0]), (1, 0, 9, [7.0, 7.0]), (3, 0, 1, [1.0, 1.0])], schema)
    ids = spark.createDataFrame([(1, 0, 1), (1, 4, 0), (2, 0, 0)], "doc bigint, entity int, new_entity int")
    unfolded = lambda df: df.select("doc", "h", "t", F.posexplode("logits").alias("class_id", "logit"))
    assert rows(unfolded(pp.fuse_logits(full, sub, 0.5, ids))) == rows(pp.fuse_logits(unfolded(full), unfolded(sub), 0.5, ids))


def test_labels_are_read_once_for_their_evidence(spark, docs):
    labs = dm.labels(docs).select("*", F.lit("read").alias("marker"))
    plan = plan_of(evi.resolve_evidence(labs, dm.mentions(docs)))
    assert plan.count("read AS marker") == 1  # a second time for the pairs that stay open


def test_pair_sums_look_up_their_own_value(spark):
    ments = spark.createDataFrame([(1, e, 0) for e in range(4)] + [(2, 0, 0)], "doc int, entity int, sent_id int")
    valued = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 1, 2), (1, 1, 0, 3), (1, 2, 1, None), (1, 0, 9, 7), (1, 3, 3, 8)], "doc int, h int, t int, v int")
    pairs = dm.candidate_pairs(ments).join(valued.groupBy("doc", "h", "t").agg(F.sum("v").alias("v")), ["doc", "h", "t"], "left")
    got, want = dm.candidate_neighbour_sums(ments, valued, ["v"]), dm.pair_neighbour_sums(pairs, ["v"])
    assert rows(got) == rows(want.select(got.columns)) and got.count() == 12
    filters = [line for line in plan_of(got).split("\n") if "Filter" in line]
    assert not any("lambdafunction" in line for line in filters)  # all ends' sums were made a second time, facts filtered anew for each, to see whether there are any


def test_facts_are_sought_only_for_pairs_that_have_some(spark):
    ments = spark.createDataFrame([(1, e, 0) for e in range(3)], "doc int, entity int, sent_id int")
    facts = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "b"), (1, 2, 0, "c"), (1, 2, 7, "d")], "doc int, h int, t int, r string")
    got = dm.candidate_facts(ments, facts)
    assert {(r.h, r.t): sorted(f.r for f in r.facts) for r in got.collect()} == {(0, 1): ["a", "b"], (0, 2): [], (1, 0): [], (1, 2): [], (2, 0): ["c"], (2, 1): []}
    assert "CASE WHEN array_contains(_known" in plan_of(got)
    hot = spark.createDataFrame([([0, 2],), (None,)], "ids array<int>").select(dm.multi_hot(F.col("ids"), 3).alias("hot"))
    assert [r.hot for r in hot.collect()] == [[1, 0, 1], [None] * 3] and "lambdafunction" not in plan_of(hot)


def test_predicted_edges_are_made_once_for_both_upserts(spark):
    plan = plan_of(QUERIES["g7_upsert_edges"](spark, GIVEN))
    assert plan.count(".predicted_") == 2 and "posexplode" not in plan  # logits were decoded for each of the two
