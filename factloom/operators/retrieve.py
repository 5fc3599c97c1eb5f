"""Graph retrieval for batches of questions: every step is keyed by ``question_id``.

Facts are (question_id, head, relation, tail, evidence) by name. Limits follow the total order
(head, relation, tail, evidence, next id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.ordering import top_per_group
from factloom.functions.vectors import cosine, cosine_topk_within
from factloom.operators.link import MENTION
from factloom.schemas import (BASELINE_FACTS, BASELINE_HOPS, ENTITY_TYPES, FACTS_PER_HOP, HUB_DEGREE, MAX_HOPS,
                              RELATION_GROUPS, RERANK_TOP_K)
from factloom.session import checkpointed

FACT = ["head", "relation", "tail", "evidence"]


def relation_groups(column: str = "relation_type") -> Column:
    """Near-synonym relation types of a relation, itself included, as an array."""
    expr = F.array(F.col(column))
    for group in RELATION_GROUPS:
        expr = F.when(F.col(column).isin(*group), F.array(*[F.lit(x) for x in sorted(group)])).otherwise(expr)
    return expr


def _ordered(*more: str) -> list[Column]:
    return [F.asc(c) for c in ("head", "relation", "tail", "evidence", *more)]


def _limited_facts(facts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return top_per_group(facts.select(*keys, *FACT).distinct(), keys, _ordered(), limit).drop("rank")


def relation_lookup(seeds: DataFrame, incidence: DataFrame, limit: int = FACTS_PER_HOP) -> DataFrame:
    """One hop along the asked relation types, either direction. ``seeds``: (question_id, node, relation_type).

    A question's first ``limit`` facts lie within the first ``limit`` of each of its nodes and relations, so hubs are cut
    to ``limit`` rows before the join; the result is the same as cutting afterwards.
    """
    per_node = _limited_facts(incidence.withColumn("asked", F.col("relation")), ["node", "asked"], limit)
    wanted = seeds.filter("relation_type IS NOT NULL").select(
        "question_id", "node", F.explode(relation_groups()).alias("asked")).distinct()
    return _limited_facts(wanted.join(per_node, ["node", "asked"]), ["question_id"], limit)


def property_scan(questions: DataFrame, named_edges: DataFrame, limit: int = FACTS_PER_HOP) -> DataFrame:
    """Facts by relation and tail name (case-insensitive), with the head type if one is asked.

    ``questions``: (question_id, relation_type, value, entity_type). Equal scans of many questions run once.
    """
    kind = F.when(F.col("entity_type").isin(*ENTITY_TYPES), F.col("entity_type"))
    asked = questions.filter("relation_type IS NOT NULL AND value IS NOT NULL").select(
        "question_id", F.col("relation_type").alias("relation"), F.lower("value").alias("key"), F.coalesce(kind, F.lit("")).alias("kind"))
    edges = named_edges.select(F.col("head_name").alias("head"), F.col("relation_type").alias("relation"),
                               F.col("tail_name").alias("tail"), "evidence", "head_type", F.lower("tail_name").alias("key"))
    scan = ["relation", "key", "kind"]
    matched = (edges.join(asked.select(*scan).distinct(), ["relation", "key"])
               .filter((F.col("kind") == "") | (F.col("kind") == F.col("head_type"))))
    limited = top_per_group(matched.select(*scan, "head", "tail", "evidence").distinct(), scan,
                            [F.asc("head"), F.asc("tail"), F.asc("evidence")], limit)
    return asked.join(limited, scan).select("question_id", *FACT)


def expandable(incidence: DataFrame, degrees: DataFrame, limit: int = FACTS_PER_HOP) -> DataFrame:
    """Each node's first ``limit`` distinct rows, with the neighbour's degree: all a limited hop can return from it."""
    first = top_per_group(incidence.select("node", *FACT, "next_id").distinct(), ["node"], _ordered("next_id"), limit)
    return first.drop("rank").join(degrees.select(F.col("id").alias("next_id"), F.col("degree").alias("next_degree")), "next_id")


def hop(frontier: DataFrame, steps: DataFrame, limit: int = FACTS_PER_HOP) -> DataFrame:
    """One hop from (question_id, node): distinct rows in order, at most ``limit`` per question."""
    rows = frontier.join(steps, "node").select("question_id", *FACT, "next_id", "next_degree").distinct()
    return top_per_group(rows, ["question_id"], _ordered("next_id"), limit).drop("rank")


def expand(seeds: DataFrame, incidence: DataFrame, degrees: DataFrame, max_hops: int = MAX_HOPS, hub: int = HUB_DEGREE,
           limit: int = FACTS_PER_HOP, dedupe: bool = True) -> DataFrame:
    """Multi-hop expansion: (question_id, hop, facts). ``seeds``: (question_id, node).

    Hubs are reported but not expanded; the limit applies before duplicate removal and hub pruning. Each hop is written
    to the checkpoint folder, so the plan stays one hop deep and a lost executor costs one hop at most.
    """
    steps = expandable(incidence, degrees, limit).persist()
    frontier = seeds.select("question_id", "node").distinct()
    visited, found = frontier, None
    for number in range(1, max_hops + 1):
        rows = checkpointed(hop(frontier, steps, limit))
        facts = rows.select("question_id", F.lit(number).alias("hop"), *FACT)
        found = facts if found is None else found.unionByName(facts)
        if number == max_hops:
            break
        nearby = rows.filter(F.col("next_degree") <= hub).select("question_id", F.col("next_id").alias("node")).distinct()
        frontier = checkpointed(nearby.join(visited, ["question_id", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    steps.unpersist()
    if not dedupe:
        return found
    return found.groupBy("question_id", *FACT).agg(F.min("hop").alias("hop")).select("question_id", "hop", *FACT)


def expand_baseline(seeds: DataFrame, incidence: DataFrame, degrees: DataFrame) -> DataFrame:
    return expand(seeds, incidence, degrees, BASELINE_HOPS, HUB_DEGREE, BASELINE_FACTS, dedupe=False)


def route(questions: DataFrame, seeds: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Adds ``route``. ``questions``: (question_id, relation_type, value); ``seeds``, ``looked_up``: rows by question."""
    has_seed = seeds.select("question_id").distinct().withColumn("_seed", F.lit(True))
    has_fact = looked_up.select("question_id").distinct().withColumn("_fact", F.lit(True))
    asked = F.col("relation_type").isNotNull()
    chosen = (F.when(F.col("_seed").isNull(), F.when(asked & F.col("value").isNotNull(), "property_scan").otherwise("no_seed"))
              .when(asked & F.col("_fact").isNotNull(), "1hop").when(asked, "1hop_fallback_bfs").otherwise("bfs"))
    return (questions.join(has_seed, "question_id", "left").join(has_fact, "question_id", "left")
            .withColumn("route", chosen).drop("_seed", "_fact"))


def retrieve(questions: DataFrame, links: DataFrame, incidence: DataFrame, degrees: DataFrame,
             named_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All questions through their routes: (question routes, facts with the route's name)."""
    seeds = links.select("question_id", F.col("id").alias("node")).distinct()
    looked = checkpointed(relation_lookup(seeds.join(questions.select("question_id", "relation_type"), "question_id"), incidence))
    routed = checkpointed(route(questions, seeds, looked))
    of = lambda *names: routed.filter(F.col("route").isin(*names)).select("question_id", "route")
    walked = expand(seeds.join(of("bfs", "1hop_fallback_bfs"), "question_id", "left_semi"), incidence, degrees)
    scanned = property_scan(routed.filter("route = 'property_scan'"), named_edges)
    facts = (looked.join(of("1hop"), "question_id")
             .unionByName(walked.drop("hop").join(of("bfs", "1hop_fallback_bfs"), "question_id"))
             .unionByName(scanned.join(of("property_scan"), "question_id")))
    return routed, facts


def rerank(facts: DataFrame, questions: DataFrame, k: int = RERANK_TOP_K) -> DataFrame:
    """Questions with more than k facts keep the k most similar; the others pass without any vector work.

    ``facts``: (question_id, fact_id, vector); ``questions``: (question_id, vector). Where questions share their facts, ``facts`` are (fact_id, vector, of) and
    ``questions`` (question_id, vector, of): a question's facts are those of its group with smaller ids, and no pair of both becomes a row before the cut.
    """
    if "question_id" not in facts.columns:
        # one more than k, which shows who has more than k
        near = cosine_topk_within(questions.withColumnRenamed("question_id", "query_id"), facts.withColumnRenamed("fact_id", "vec_id"), k + 1, earlier=True)
        many = F.max("rank").over(W.partitionBy("query_id")) > k
        return near.withColumn("_many", many).filter(F.col("rank") <= k).select(
            F.col("query_id").alias("question_id"), F.col("vec_id").alias("fact_id"), F.when(F.col("_many"), F.col("similarity")).alias("similarity"))
    sizes = facts.groupBy("question_id").agg(F.count("*").alias("_n"))
    many, few = sizes.filter(F.col("_n") > k), sizes.filter(F.col("_n") <= k)
    asked = questions.select("question_id", F.col("vector").alias("_q")).join(many.select("question_id"), "question_id", "left_semi")
    scored = facts.join(asked, "question_id").withColumn(
        "similarity", F.round(cosine(F.col("vector"), F.col("_q")), 6)).drop("_q")
    best = top_per_group(scored, ["question_id"], [F.desc("similarity"), F.asc("fact_id")], k).drop("rank")
    passed = facts.join(few.select("question_id"), "question_id", "left_semi").withColumn("similarity", F.lit(None).cast("double"))
    return best.unionByName(passed)


# fixed value: the evidence label of a formatted fact
EVIDENCE_LABEL = "근거"


def fact_line(label: str = EVIDENCE_LABEL) -> Column:
    line = F.concat(F.lit("- "), "head", F.lit(" -["), "relation", F.lit("]-> "), "tail")
    return F.when(F.col("evidence") != "", F.concat(line, F.lit(f" ({label}: "), "evidence", F.lit(")"))).otherwise(line)


def format_facts(facts: DataFrame, label: str = EVIDENCE_LABEL) -> DataFrame:
    """One text block per question from its limited facts."""
    lines = facts.withColumn("line", fact_line(label))
    return lines.groupBy("question_id").agg(
        F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("context"))


def evidence_only(facts: DataFrame) -> DataFrame:
    return facts.filter("evidence <> ''").groupBy("question_id").agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))


def majority_vote(samples: DataFrame, groupings: DataFrame) -> DataFrame:
    """Final answer and votes per question.

    ``samples``: (question_id, idx, answer); ``groupings``: (question_id, group_ids). All answers equal: first answer,
    n votes. Grouping missing or of the wrong length: first answer, one vote. Else the largest group's first member;
    equal groups: the one seen first.
    """
    base = samples.groupBy("question_id").agg(
        F.count("*").alias("n"), F.min("answer").alias("lo"), F.max("answer").alias("hi"), F.min_by("answer", "idx").alias("first"))
    valid = base.join(groupings, "question_id").filter("size(group_ids) = n AND lo <> hi")
    best = (valid.select("question_id", F.posexplode("group_ids").alias("idx", "gid"))
            .groupBy("question_id", "gid").agg(F.count("*").alias("c"), F.min("idx").alias("idx"))
            .groupBy("question_id").agg(F.max(F.struct("c", (-F.col("idx")).alias("neg"))).alias("b"))
            .select("question_id", F.col("b.c").alias("c"), (-F.col("b.neg")).alias("idx")))
    member = best.join(samples, ["question_id", "idx"]).select("question_id", "c", F.col("answer").alias("chosen"))
    return base.join(member, "question_id", "left").select(
        "question_id", F.coalesce("chosen", "first").alias("answer"), "n",
        F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(F.coalesce("c", F.lit(1))).alias("votes"))


def weak_consensus(votes: str = "votes", n: str = "n") -> Column:
    return 2 * F.col(votes) < F.col(n)


def hop_distance(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(question_id, name, distance) inside each question's facts, undirected; unreached nodes are absent.

    ``seeds``: (question_id, name). One round per distance; the frontier shrinks to nothing.
    """
    ends = F.inline(F.array(F.struct(F.col("head").alias("name"), F.col("tail").alias("other")),
                            F.struct(F.col("tail").alias("name"), F.col("head").alias("other"))))
    arcs = facts.select("question_id", ends).distinct().persist()
    key = ["question_id", "name"]
    frontier = checkpointed(seeds.select(*key).distinct().join(arcs.select(*key).distinct(), key, "left_semi")
                            .withColumn("distance", F.lit(0)))
    reached, step = frontier, 0
    while not frontier.isEmpty():
        step += 1
        near = frontier.select(*key).join(arcs, key).select("question_id", F.col("other").alias("name")).distinct()
        frontier = checkpointed(near.join(reached.select(*key), key, "left_anti").withColumn("distance", F.lit(step)))
        reached = reached.unionByName(frontier)
    arcs.unpersist()
    return reached


def node_relevance(distance: Column) -> Column:
    return F.when(distance <= 1, 1.0).when(distance == 2, 0.7).otherwise(0.45)


def relevance(facts: DataFrame, distances: DataFrame) -> DataFrame:
    """Facts with the smaller relevance of their two ends, and whether that is near (at least 0.7)."""
    d = distances.select("question_id", "name", "distance")
    both = (facts.join(d.withColumnsRenamed({"name": "head", "distance": "_h"}), ["question_id", "head"], "left")
            .join(d.withColumnsRenamed({"name": "tail", "distance": "_t"}), ["question_id", "tail"], "left"))
    score = F.least(node_relevance(F.col("_h")), node_relevance(F.col("_t")))
    return both.withColumn("relevance", score).withColumn("near", F.col("relevance") >= 0.7).drop("_h", "_t")


def cited_names(answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a question whose name occurs in its answer."""
    return (nodes.select("question_id", "name").distinct().filter("name <> ''").join(answers, "question_id")
            .filter(F.contains("answer", "name")).select("question_id", "name"))


def enrich(facts: DataFrame, entities: DataFrame, named_edges: DataFrame) -> DataFrame:
    """Facts with end types (``MISC`` when unknown) and evidence source, first match by type and document."""
    kind = entities.groupBy("name").agg(F.min("type").alias("kind"))
    source = named_edges.groupBy(F.col("head_name").alias("head"), F.col("relation_type").alias("relation"),
                                 F.col("tail_name").alias("tail")).agg(F.min_by("evidence_source", "document").alias("evidence_source"))
    return (facts.join(kind.select(F.col("name").alias("head"), F.col("kind").alias("head_type")), "head", "left")
            .join(kind.select(F.col("name").alias("tail"), F.col("kind").alias("tail_type")), "tail", "left")
            .join(source, ["head", "relation", "tail"], "left").fillna("MISC", ["head_type", "tail_type"]))


def all_exact(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Per question: every mention has a match whose name equals it, case-insensitively."""
    hit = links.filter(F.lower("name") == F.lower("mention")).select(*MENTION).distinct().withColumn("hit", F.lit(True))
    return (mentions.select(*MENTION).distinct().join(hit, MENTION, "left").groupBy("question_id")
            .agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_exact")))


def result_summary(enriched: DataFrame) -> DataFrame:
    """Per question and node type: nodes and their names, next to the question's fact count."""
    node = F.inline(F.array(F.struct(F.col("head").alias("name"), F.col("head_type").alias("type")),
                            F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("type"))))
    per_type = enriched.select("question_id", node).distinct().groupBy("question_id", "type").agg(
        F.count("*").alias("n_nodes"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    n_facts = enriched.groupBy("question_id").agg(F.count("*").alias("n_facts"))
    return per_type.join(n_facts, "question_id")


def memo_key(*parts: str) -> Column:
    """SHA-1 of the JSON list of the parts."""
    return F.sha1(F.to_json(F.array(*[F.col(p).cast("string") for p in parts])).cast("binary"))


def memo_split(df: DataFrame, memo: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a stored value, and rows still to compute (once per key)."""
    keyed = df.withColumn("key", memo_key(*parts))
    known = keyed.join(memo.select("key", "value"), "key")
    unknown = keyed.dropDuplicates(["key"]).join(memo.select("key"), "key", "left_anti")
    return known, unknown


def memo_stats(memo: DataFrame) -> DataFrame:
    return memo.agg(F.count("*").alias("entries"), F.sum(F.octet_length("value")).alias("bytes"))
