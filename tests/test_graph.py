import random

from pyspark.sql import functions as F

from factloom.functions.vectors import cosine_topk
from factloom.operators import evaluate as ev
from factloom.operators import graph as g
from factloom.operators import link as lk
from factloom.operators import repair as rp
from factloom.operators import retrieve as rt


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def mistyped(rng, word):
    out = list(word)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(out))
        action = rng.randrange(3)
        if action == 0 and len(out) > 1:
            del out[i]
        elif action == 1:
            out.insert(i, rng.choice("abcé "))
        else:
            out[i] = rng.choice("abcé ")
    return "".join(out)


def test_published_ratios(spark):
    pairs = spark.createDataFrame([("Googel", "Google"), ("Micorsoft", "Microsoft"), ("Ankara", "Sankara")], "a string, b string")
    from factloom.functions.similarity import indel_ratio
    got = [round(r[0], 1) for r in pairs.select(indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [83.3, 88.9, 76.9]


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(150)]
    asked = sorted({mistyped(rng, w) for w in words} - {""})
    names = sorted(set(words))
    a = spark.createDataFrame([(m,) for m in asked], "mention string")
    b = spark.createDataFrame([(n,) for n in names], "name string")
    for cutoff in (40, 66, 80, 90):
        want = {(m, n) for m in asked for n in names if ratio(m, n) >= cutoff}
        assert {(r["mention"], r["name"]) for r in lk.fuzzy_pairs(a, b, cutoff).collect()} == want
    entities = b.select(F.col("name").alias("id"), "name", F.lit("ORG").alias("type"))
    for cutoff, k in ((80, 3), (50, 2), (100, 1)):
        got = {}
        for r in lk.link_fuzzy(a.withColumn("question_id", F.lit(1)), entities, cutoff, k).collect():
            got.setdefault(r["mention"], set()).add(r["id"])
        for m in asked:
            ranked = sorted((n for n in names if ratio(m, n) >= cutoff), key=lambda n: (-ratio(m, n), n))[:k]
            assert got.get(m, set()) == set(ranked), (m, cutoff)


def test_struck_letters_find_every_close_pair(spark):
    rng = random.Random(8)
    base = ["Customer#00000" + "".join(rng.choices("0123", k=4)) for _ in range(60)] + ["x" * 39, "x" * 41, "x" * 43, "", "ab", "a"]
    names = sorted(set(base))
    asked = sorted({mistyped(rng, w) for w in names} | {"", "x" * 40, "x" * 42, "customer#000000123"})
    a, b = (spark.createDataFrame([(m,) for m in some], f"{name} string") for some, name in ((asked, "mention"), (names, "name")))
    for letters in (0, 1, 2):
        got = {(r["mention"], r["name"]) for r in lk.struck_pairs(a, b, letters).collect()}

        def near(m, n):
            common = ratio(m, n) * (len(m) + len(n)) / 200
            return max(len(m), len(n)) - common <= letters + 1e-9

        assert got == {(m, n) for m in asked for n in names if len(m) <= 40 and len(n) <= 40 + letters and near(m, n)}
        bound = {r["mention"]: r["bound"] for r in lk._unseen(b, a, letters).collect()}
        assert all(ratio(m, n) <= bound[m] + 1e-9 for m in asked for n in names if m and (m, n) not in got)


def test_link_cascade(spark):
    entities = spark.createDataFrame([
        ("1", "Ankara", "LOC", ["Angora"]), ("2", "Vinod Mankara", "PER", []), ("3", "Google", "ORG", []), ("4", "Bank of Ankara", "ORG", []), ("5", "C++ (language)", "MISC", [])],
        "id string, name string, type string, aliases array<string>")
    asked = spark.createDataFrame([(1, "ankara"), (2, "angora"), (3, "bank"), (4, "Googel"), (5, "Nobody"), (6, "C++")], "question_id long, mention string")
    got = {r["mention"]: (r["id"], r["stage"]) for r in lk.link(asked, entities).collect()}
    assert got == {"ankara": ("1", "exact"), "angora": ("1", "alias"), "bank": ("4", "word_boundary"), "Googel": ("3", "fuzzy")}
    subs = {(r["mention"], r["id"]) for r in lk.link_substring(asked, entities).collect()}
    assert subs == {("ankara", "1"), ("ankara", "2"), ("ankara", "4"), ("angora", "1"), ("bank", "4"), ("C++", "5")}


def graph(spark, arcs):
    edges = spark.createDataFrame([(a, "R", b, f"d{i}", f"{a}-{b}") for i, (a, b) in enumerate(arcs)],
                                  "head_id string, relation_type string, tail_id string, document string, evidence string")
    nodes = sorted({x for arc in arcs for x in arc})
    return edges, spark.createDataFrame([(n, n, "ORG", [n]) for n in nodes], "id string, name string, type string, aliases array<string>")


def test_expand_stops_at_hubs_and_visited(spark):
    arcs = [("a", "b"), ("b", "hub"), ("hub", "z")] + [("hub", f"x{i:02d}") for i in range(5)]
    edges, nodes = graph(spark, arcs)
    inc, deg = g.incidence(edges, nodes), g.degrees(edges)
    seeds = spark.createDataFrame([(1, "a")], "question_id long, node string")
    facts = rt.expand(seeds, inc, deg, max_hops=5, hub=3).collect()
    assert {(r["hop"], r["head"], r["tail"]) for r in facts} == {(1, "a", "b"), (2, "b", "hub")}
    wide = {(r["head"], r["tail"]) for r in rt.expand(seeds, inc, deg, max_hops=5, hub=100).collect()}
    assert wide == set(arcs)
    fewer = {(r["head"], r["tail"]) for r in rt.expand(seeds, inc, deg, max_hops=2, hub=100).collect()}
    assert fewer <= wide
    limited = rt.expand(spark.createDataFrame([(1, "hub")], "question_id long, node string"), inc, deg, max_hops=1, limit=3).collect()
    assert sorted(r["tail"] for r in limited) == ["hub", "x00", "x01"]


def test_retrieve_routes(spark):
    edges, nodes = graph(spark, [("a", "b"), ("b", "c")])
    questions = spark.createDataFrame([(1, "R", None, None), (2, "OTHER", None, None), (3, None, None, None), (4, "R", "c", None), (5, None, None, None)],
                                      "question_id long, relation_type string, value string, entity_type string")
    links = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "question_id long, id string")
    routes, facts = rt.retrieve(questions, links, g.incidence(edges, nodes), g.degrees(edges), g.ends_joined(edges, nodes))
    assert {r["question_id"]: r["route"] for r in routes.collect()} == {1: "1hop", 2: "1hop_fallback_bfs", 3: "bfs", 4: "property_scan", 5: "no_seed"}
    got = {(r["question_id"], r["head"], r["tail"]) for r in facts.collect()}
    assert got == {(1, "a", "b"), (2, "a", "b"), (2, "b", "c"), (3, "a", "b"), (3, "b", "c"), (4, "b", "c")}


def test_cosine_blocks_equal_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, vector array<float>")
    found = cosine_topk(df.withColumnRenamed("vec_id", "query_id"), df, 4, query_block=7, index_block=11, pivots=5).collect()
    check_nearest(found, vecs, vecs, 4)


def check_nearest(found, asked, vecs, k):
    import numpy as np

    def unit(v):
        size = np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
        return v.astype("float64") / np.where(size == 0, 1e-9, size)

    sims = np.round(unit(asked) @ unit(vecs).T, 6)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    for q in range(len(asked)):
        want = sorted((i for i in range(len(vecs)) if i != q), key=lambda i: (-sims[q, i], i))[:k]
        assert [v for v, _ in got.get(q, [])] == want, q


def test_cosine_pivots_rule_out_most_of_clustered_vectors(spark, monkeypatch):
    import numpy as np

    from factloom.functions import vectors

    monkeypatch.setattr(vectors, "CELL", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 4
    vecs = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.4).astype("float32")
    vecs[[3, 700]] = 0  # a zero vector is at right angles to all
    vecs[900:910] = vecs[0]  # ties go by id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, vector array<float>")
    report = {}
    found = cosine_topk(df.withColumnRenamed("vec_id", "query_id"), df, 5, query_block=50, index_block=100, report=report)
    check_nearest(found.collect(), vecs, vecs, 5)
    assert report["pairs"] == 1500 ** 2 and report["compared"] < 0.5 * report["pairs"] and report["blocks"] > 20
    none = df.limit(0)
    assert cosine_topk(none.withColumnRenamed("vec_id", "query_id"), df, 5).collect() == cosine_topk(df.withColumnRenamed("vec_id", "query_id"), none, 5).collect() == []
    few = cosine_topk(df.filter("vec_id < 4").withColumnRenamed("vec_id", "query_id"), df.filter("vec_id < 3"), 5).collect()
    check_nearest(few, vecs[:4], vecs[:3], 5)


def test_upsert_is_idempotent_and_order_free(spark):
    base, _ = graph(spark, [("a", "b"), ("b", "c")])
    base = base.withColumn("seq", F.lit(0))
    new = base.filter("head_id = 'a'").withColumn("evidence", F.lit("newer"))
    once = g.upsert_edges(base, new)
    again = g.upsert_edges(once.repartition(3), new)
    key = lambda df: sorted((r["head_id"], r["evidence"]) for r in df.collect())
    assert key(once) == key(again) == [("a", "newer"), ("b", "b-c")]


def test_merge_chain_and_second_run_finds_nothing(spark):
    arcs = [("Acme", "x"), ("Acme", "y"), ("Acme Inc.", "x"), ("Acme Ltd", "z")]
    edges, nodes = graph(spark, arcs)
    cands = rp.suffix_candidates(nodes)
    assert {(r["short_id"], r["long_id"]) for r in cands.collect()} == {("Acme", "Acme Inc."), ("Acme", "Acme Ltd")}
    near = g.incidence(edges, nodes).select("node", "relation", F.col("next_id").alias("name"))
    verdicts = {r["long_id"]: r["verdict"] for r in rp.rule_verdict(cands, near).collect()}
    assert verdicts == {"Acme Inc.": "merge", "Acme Ltd": "undecided"}
    plan = rp.merge_plan(cands, nodes, g.degrees(edges))
    assert {(r["drop_id"], r["keep_id"]) for r in plan.collect()} == {("Acme Inc.", "Acme"), ("Acme Ltd", "Acme")}
    merged, moved = rp.apply_merges(nodes, edges, plan)
    assert {r["head_id"] for r in moved.collect()} == {"Acme"} and moved.count() == 4
    assert rp.apply_merges(nodes, edges, plan, key="pair")[1].count() == 3
    assert [r["aliases"] for r in merged.filter("id = 'Acme'").collect()] == [["Acme", "Acme Inc.", "Acme Ltd"]]
    assert rp.suffix_candidates(merged).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("p", "q")], "a string, b string")
    labels = {r["id"]: r["component"] for r in rp.connected_components(pairs).collect()}
    assert set(labels.values()) == {"n000", "p"} and len(labels) == 43


def test_topology_gate_and_demonyms(spark):
    edges = spark.createDataFrame([("A Inc.", "SUBSIDIARY", "A"), ("x", "COUNTRY", "French"), ("French", "COUNTRY", "x")], "head_id string, relation_type string, tail_id string")
    cands = spark.createDataFrame([("A", "A", "A Inc.", "A Inc.")], "short_id string, short_name string, long_id string, long_name string")
    assert rp.topology_gate(cands, edges).first()["gate"] == "reject"
    assert rp.topology_gate(cands, edges, [("A", "A Inc.")]).first()["gate"] == "override"
    nodes = spark.createDataFrame([("French", "French", "LOC"), ("x", "x", "ORG"), ("France::LOC", "France", "LOC"), ("A", "A", "ORG"), ("A Inc.", "A Inc.", "ORG")],
                                  "id string, name string, type string")
    named = g.ends_joined(edges.withColumn("edge_id", F.concat_ws(">", "head_id", "tail_id")).withColumn("document", F.lit("d")), nodes)
    found = rp.demonym_candidates(named, nodes, rp.demonym_table(spark, {"German": "Germany", "Indian": "India", "Dutch": "Netherlands", "French": "France"}))
    assert {(r["edge_id"], r["side"], r["canonical_id"]) for r in found.collect()} == {("x>French", "tail", "France::LOC"), ("French>x", "head", "France::LOC")}
    verdicts = spark.createDataFrame([("x>French", "yes")], "edge_id string, verdict string")
    moved, rest = rp.repoint(named.select("edge_id", "head_id", "tail_id"), found, verdicts)
    assert ("x", "France::LOC") in {(r["head_id"], r["tail_id"]) for r in moved.collect()}
    assert [r["edge_id"] for r in rest.collect()] == ["French>x"]


def test_scores_without_predictions(spark):
    gold = spark.createDataFrame([(1, 0, 1, "P1")], "doc long, h int, t int, r string")
    row = ev.score(gold.filter("false"), gold).first()
    assert (row["precision"], row["recall"], row["f1"], row["n_gold"]) == (0.0, 0.0, 0.0, 1)


def test_retrieval_metrics_count_first_hits(spark):
    matched = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, None)], "question_id long, pos int, gold_idx int")
    n_gold = spark.createDataFrame([(1, 2), (2, 0)], "question_id long, n_gold int")
    rows = {r["question_id"]: r for r in ev.retrieval_metrics(matched, n_gold).collect()}
    assert round(rows[1]["precision"], 4) == 0.6667 and rows[1]["recall"] == 0.5 and rows[1]["ap"] == 0.5
    assert rows[2]["precision"] == rows[2]["ndcg"] == 0.0


def test_majority_vote_rules(spark):
    samples = spark.createDataFrame([(q, i, a) for q, answers in {1: "xyy", 2: "zzz", 3: "abc", 4: "abc"}.items() for i, a in enumerate(answers)],
                                    "question_id long, idx int, answer string")
    groups = spark.createDataFrame([(1, [0, 1, 1]), (3, [0, 1]), (4, [2, 1, 0])], "question_id long, group_ids array<int>")
    got = {r["question_id"]: (r["answer"], r["votes"]) for r in rt.majority_vote(samples, groups).collect()}
    assert got == {1: ("y", 2), 2: ("z", 3), 3: ("a", 1), 4: ("a", 1)}


def test_select_run_blocks(spark):
    f1 = [0.1, 0.3, 0.3, 0.2, 0.5, 0.4, 0.4, 0.4, 0.9]
    history = spark.createDataFrame([(1, e, v) for e, v in enumerate(f1)], "run long, epoch int, f1 double")
    assert {r["epoch"] for r in ev.improvements(history, block=2).collect()} == {0, 1, 4, 8}
    row = ev.select_run(history, 3).first()
    assert (row["stop_epoch"], row["stopped_early"], row["best_epoch"]) == (7, True, 4)


def test_stream_equals_batch_under_replay(spark, tmp_path):
    from factloom.streaming.upsert import compact, read_stream, read_upserted, stream_upsert
    edges, _ = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    edges = edges.withColumn("seq", F.monotonically_increasing_id())
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    edges.repartition(1).write.parquet(source)
    newer = edges.filter("head_id = 'b'").withColumn("evidence", F.lit("newer"))
    for checkpoint in ("c1", "c1"):
        stream_upsert(read_stream(spark, source, edges.schema, 1), target, str(tmp_path / checkpoint)).awaitTermination()
        newer.repartition(1).write.mode("append").parquet(source)
    state = lambda df: sorted((r["head_id"], r["evidence"]) for r in df.collect())
    want = state(g.upsert_edges(edges, newer))
    assert state(read_upserted(spark, target)) == want
    # the whole stream once more from the start, into the same folders
    stream_upsert(read_stream(spark, source, edges.schema, 1), target, str(tmp_path / "c2")).awaitTermination()
    assert state(read_upserted(spark, target)) == want
    compact(spark, target, str(tmp_path / "packed"))
    assert state(read_upserted(spark, str(tmp_path / "packed"))) == want


def test_word_boundary_equals_brute_force(spark):
    import re

    rng = random.Random(11)
    words = ["bank", "Bank", "of", "a", "b_1", "X", "kelvin", "Kelvin", "C++", "é"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(120)} | {"bankof", "bank.of", "bank-a"})
    asked = ["bank", "BANK", "of a", "bank of", "b_1", "x", "kelvin", "C++", "é", "a.", "bankof", "nobody", ""]
    entities = spark.createDataFrame([(f"{i:03d}", n, "ORG", [names[-i - 1]] if i % 3 == 0 else []) for i, n in enumerate(names)], "id string, name string, type string, aliases array<string>")
    mentions = spark.createDataFrame([(i, m) for i, m in enumerate(asked)], "question_id long, mention string")
    got = {}
    for r in lk.link_word_boundary(mentions, entities, 3).collect():
        got.setdefault(r["mention"], []).append(r["id"])
    for m in asked:
        low = m.translate({c: c + 32 for c in range(65, 91)})
        head, tail = (r"(?<![a-z0-9_])" if re.match(r"[a-z0-9_]", low) else r"(?<=[a-z0-9_])"), (r"(?![a-z0-9_])" if re.search(r"[a-z0-9_]$", low) else r"(?=[a-z0-9_])")
        pattern = re.compile(head + re.escape(low) + tail)

        def hit(surface):
            return bool(m) and bool(pattern.search(surface.translate({c: c + 32 for c in range(65, 91)})))

        want = [f"{i:03d}" for i, n in enumerate(names) if hit(n) or (i % 3 == 0 and hit(names[-i - 1]))][:3]
        assert sorted(got.get(m, [])) == want, m
