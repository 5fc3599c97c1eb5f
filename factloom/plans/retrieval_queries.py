"""Entity linking and retrieval queries over the trade graph and the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import joined
from factloom.functions.vectors import cosine_topk
from factloom.operators import graph as g
from factloom.operators import link as lk
from factloom.operators import retrieve as rt
from factloom.plans.graph_queries import corpus_entities
from factloom.plans.registry import query


def mentions(t):
    return t.tg_questions.select("question_id", "mention")


def top3(hit: str, source: str = "tg_entities") -> str:
    return f"""SELECT q.question_id, q.mention, e.id, e.name, e.type FROM tg_questions q JOIN {source} e ON {hit}
QUALIFY row_number() OVER (PARTITION BY q.question_id, q.mention ORDER BY e.id) <= 3"""


EXACT = top3("lower(e.name) = lower(q.mention)")


@query("q1_link_exact", EXACT)
def q1(t):
    return lk.link_exact(mentions(t), t.tg_entities)


# part and supplier names in other spellings find the corpus entities by alias
@query("q2_link_alias", """
WITH a AS (SELECT DISTINCT c.name || '::' || c.type AS id, c.name, c.type, lower(m.name) AS alias FROM canon c
  JOIN oc_mentions m ON m.doc = c.doc AND m.entity = c.entity),
q AS (SELECT p_partkey AS question_id, upper(p_name) AS mention FROM part UNION ALL SELECT 1000000 + s_suppkey, lower(s_name) FROM supplier)
SELECT question_id, mention, id, name, type FROM (SELECT DISTINCT q.question_id, q.mention, a.id, a.name, a.type FROM q JOIN a ON a.alias = lower(q.mention))
QUALIFY row_number() OVER (PARTITION BY question_id, mention ORDER BY id) <= 3""")
def q2(t):
    asked = t.part.select(F.col("p_partkey").alias("question_id"), F.upper("p_name").alias("mention")).unionByName(
        t.supplier.select((F.col("s_suppkey") + 1000000).alias("question_id"), F.lower("s_name").alias("mention")))
    return lk.link_alias(asked, corpus_entities(t))


# the substring test is implied by the pattern and spares most of its evaluations
WORD = top3("CASE WHEN contains(lower(e.name), lower(q.mention)) THEN regexp_matches(e.name, '(?i)\\b' || regexp_replace(q.mention, '([#.])', '\\\\\\1', 'g') || '\\b') END")


@query("q3_link_word_boundary", WORD)
def q3(t):
    return lk.link_word_boundary(mentions(t), t.tg_entities)


# the longest common subsequence of two names by bits: a set bit of the state is a letter of the name that is not in it yet
FUZZY = """
a AS (SELECT DISTINCT mention, string_split(mention, '') AS letters, length(mention) AS la FROM tg_questions),
b AS (SELECT name, length(name) AS lb, (1::HUGEINT << length(name)) - 1 AS every, map_from_entries(list_transform(list_distinct(string_split(name, '')),
    lambda c: {'k': c, 'v': list_sum(list_transform(range(1, length(name) + 1), lambda j: CASE WHEN name[j] = c THEN 1::HUGEINT << (j - 1) ELSE 0 END))::HUGEINT})) AS places
  FROM (SELECT DISTINCT name FROM tg_entities)),
rated AS (SELECT mention, name, 200.0 * (lb - bit_count(list_reduce(list_prepend(every, list_transform(letters, lambda c: coalesce(places[c], 0::HUGEINT))),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & every))) / (la + lb) AS ratio FROM a, b WHERE least(la, lb) * 200 >= 80 * (la + lb)),
fuzzy AS (SELECT r.mention, e.id, e.name, e.type, r.ratio FROM rated r JOIN tg_entities e USING (name) WHERE ratio >= 80
  QUALIFY row_number() OVER (PARTITION BY r.mention ORDER BY ratio DESC, e.id) <= 3)"""


@query("q4_link_fuzzy", f"WITH {FUZZY} SELECT question_id, mention, id, name, type, round(ratio::DOUBLE, 6) AS ratio FROM tg_questions JOIN fuzzy USING (mention)")
def q4(t):
    return lk.link_fuzzy(mentions(t), t.tg_entities).withColumn("ratio", F.round("ratio", 6))


@query("q5_link_cascade", f"""
WITH {FUZZY}, exact AS ({EXACT}), word AS ({WORD}), third AS (SELECT question_id, mention, id, name, type FROM tg_questions JOIN fuzzy USING (mention))
SELECT *, 'exact' AS stage FROM exact UNION ALL SELECT *, 'word_boundary' FROM word WHERE (question_id, mention) NOT IN (SELECT question_id, mention FROM exact)
UNION ALL SELECT *, 'fuzzy' FROM third WHERE (question_id, mention) NOT IN (SELECT question_id, mention FROM exact)
  AND (question_id, mention) NOT IN (SELECT question_id, mention FROM word)""")
def q5(t):
    return lk.link(mentions(t), t.tg_entities)


# two spellings of every supplier: as an organisation and, for some, as a person; the hint keeps the organisation
HINT_ENTITIES = """SELECT s_name || '::ORG' AS id, s_name AS name, 'ORG' AS type FROM supplier
  UNION ALL SELECT s_name || '::PER', s_name, 'PER' FROM supplier WHERE s_acctbal > 3000"""


@query("q6_type_hint", f"""
WITH l AS (SELECT s_suppkey AS question_id, s_name AS mention, e.id, e.name, e.type,
    CASE WHEN s_nationkey < 8 THEN 'PER' WHEN s_nationkey < 16 THEN 'LOC' END AS hint FROM supplier JOIN ({HINT_ENTITIES}) e ON e.name = s_name)
SELECT question_id, mention, id, name, type FROM l
QUALIFY coalesce(type = hint, false) OR NOT bool_or(coalesce(type = hint, false)) OVER (PARTITION BY question_id, mention)""")
def q6(t):
    entities = t.sql(HINT_ENTITIES)
    asked = t.supplier.select(F.col("s_suppkey").alias("question_id"), F.col("s_name").alias("mention"),
                              F.when(F.col("s_nationkey") < 8, "PER").when(F.col("s_nationkey") < 16, "LOC").alias("hint"))
    return lk.apply_type_hint(lk.link_exact(asked, entities), asked)


@query("q7_link_substring", top3("contains(lower(e.name), lower(q.mention))"))
def q7(t):
    return lk.link_substring(mentions(t), t.tg_entities)


@query("q8_validated_questions", """
SELECT c_custkey AS question_id, c_name || '|' || c_mktsegment AS entities,
  CASE WHEN c_nationkey < 5 THEN '-|-' ELSE 'ORG|-' END AS hints,
  CASE WHEN c_nationkey < 10 THEN 'COUNTRY' END AS relation_type, CASE WHEN c_acctbal > 0 THEN 'NATION_1' END AS value,
  CASE WHEN c_acctbal > 5000 THEN 'ORG' END AS entity_type FROM customer""")
def q8(t):
    parsed = t.customer.select(
        F.col("c_custkey").alias("question_id"), F.array("c_name", "c_mktsegment").alias("entities"),
        F.when(F.col("c_nationkey") < 5, F.array(F.lit("ORG"))).otherwise(F.array(F.lit("ORG"), F.lit("COMPANY"))).alias("entity_hints"),
        F.when(F.col("c_nationkey") < 10, "COUNTRY").otherwise("EATS").alias("relation_type"),
        F.when(F.col("c_acctbal") > 0, "NATION_1").otherwise("").alias("value"),
        F.when(F.col("c_acctbal") > 5000, "ORG").otherwise("FIRM").alias("entity_type"))
    out = lk.validate_queries(parsed, t.tg_edges.select("relation_type").distinct())
    return out.select("question_id", joined(F.col("entities"), "|").alias("entities"),
                      F.array_join("entity_hints", "|", "-").alias("hints"), "relation_type", "value", "entity_type")


@query("q9_relation_groups", """
SELECT DISTINCT relation_type, unnest(CASE relation_type WHEN 'MANUFACTURER' THEN ['MANUFACTURER', 'PRODUCT_OR_MATERIAL_PRODUCED']
  WHEN 'HEAD_OF_STATE' THEN ['HEAD_OF_GOVERNMENT', 'HEAD_OF_STATE'] ELSE [relation_type] END) AS member FROM tg_seeds""")
def q9(t):
    return t.tg_seeds.select("relation_type").distinct().select("relation_type", F.explode(rt.relation_groups()).alias("member"))


def incidence(t):
    return g.incidence(t.tg_edges, t.tg_entities)


def seeds(t):
    return t.tg_seeds.select("question_id", F.col("seed_id").alias("node"), "relation_type")


LOOKUP = """
SELECT question_id, head, relation, tail, evidence FROM (
  SELECT DISTINCT s.question_id, i.head, i.relation, i.tail, i.evidence FROM tg_seeds s JOIN tg_incidence i ON i.node = s.seed_id
  AND i.relation IN (s.relation_type, CASE s.relation_type WHEN 'MANUFACTURER' THEN 'PRODUCT_OR_MATERIAL_PRODUCED' WHEN 'HEAD_OF_STATE' THEN 'HEAD_OF_GOVERNMENT' END))
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail, evidence) <= 60"""


@query("q10_relation_lookup", LOOKUP)
def q10(t):
    return rt.relation_lookup(seeds(t), incidence(t))


@query("q11_property_scan", """
SELECT question_id, head, relation, tail, evidence FROM (
  SELECT DISTINCT q.question_id, h.name AS head, e.relation_type AS relation, x.name AS tail, e.evidence
  FROM (SELECT c_custkey AS question_id, lower('NATION_' || c_nationkey) AS value, CASE WHEN c_acctbal > 4000 THEN 'ORG' WHEN c_acctbal > 2000 THEN 'PER' END AS kind FROM customer) q
  JOIN tg_entities x ON lower(x.name) = q.value JOIN tg_edges e ON e.tail_id = x.id AND e.relation_type = 'COUNTRY'
  JOIN tg_entities h ON h.id = e.head_id WHERE q.kind IS NULL OR h.type = q.kind)
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail, evidence) <= 60""")
def q11(t):
    asked = t.customer.select(
        F.col("c_custkey").alias("question_id"), F.lit("COUNTRY").alias("relation_type"),
        F.lower(F.concat(F.lit("NATION_"), "c_nationkey")).alias("value"),
        F.when(F.col("c_acctbal") > 4000, "ORG").when(F.col("c_acctbal") > 2000, "PER").otherwise("FIRM").alias("entity_type"))
    return rt.property_scan(asked, g.ends_joined(t.tg_edges, t.tg_entities))


def hop_ctes(hops: int, limit: int, hub: int, seeds: str = "SELECT DISTINCT question_id, seed_id AS node FROM tg_seeds") -> str:
    parts = [f"f0 AS ({seeds})", "v0 AS (SELECT * FROM f0)"]
    for i in range(1, hops + 1):
        parts.append(f"""h{i} AS (SELECT * FROM (SELECT DISTINCT f.question_id, i.head, i.relation, i.tail, i.evidence, i.next_id, d.degree
  FROM f{i-1} f JOIN tg_incidence i ON i.node = f.node JOIN tg_degree d ON d.id = i.next_id)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail, evidence, next_id) <= {limit})""")
        parts.append(f"""f{i} AS (SELECT DISTINCT question_id, next_id AS node FROM h{i} h WHERE degree <= {hub}
  AND NOT EXISTS (SELECT 1 FROM v{i-1} v WHERE v.question_id = h.question_id AND v.node = h.next_id))""")
        parts.append(f"v{i} AS (SELECT * FROM v{i-1} UNION ALL SELECT * FROM f{i})")
    return "WITH " + ",\n".join(parts)


def all_hops(hops: int) -> str:
    return " UNION ALL ".join(f"SELECT question_id, {i} AS hop, head, relation, tail, evidence FROM h{i}" for i in range(1, hops + 1))


@query("q12_hop", f"{hop_ctes(1, 60, 40)} SELECT question_id, head, relation, tail, evidence, next_id, degree AS next_degree FROM h1")
def q12(t):
    steps = rt.expandable(incidence(t), g.degrees(t.tg_edges))
    return rt.hop(seeds(t).select("question_id", "node").distinct(), steps)


@query("q13_expand", f"""{hop_ctes(5, 60, 40)}
SELECT question_id, min(hop) AS hop, head, relation, tail, evidence FROM ({all_hops(5)}) GROUP BY question_id, head, relation, tail, evidence""")
def q13(t):
    return rt.expand(seeds(t), incidence(t), g.degrees(t.tg_edges))


@query("q14_expand_baseline", f"{hop_ctes(3, 200, 40)} {all_hops(3)}")
def q14(t):
    return rt.expand_baseline(seeds(t), incidence(t), g.degrees(t.tg_edges))


ROUTE = f"""
WITH s AS ({EXACT}), l AS (SELECT DISTINCT s.question_id FROM s JOIN tg_questions q ON q.question_id = s.question_id
  JOIN tg_incidence i ON i.node = s.id AND i.relation = q.relation_type)
SELECT question_id, CASE WHEN question_id NOT IN (SELECT question_id FROM s) THEN CASE WHEN relation_type IS NOT NULL AND value IS NOT NULL THEN 'property_scan' ELSE 'no_seed' END
  WHEN relation_type IS NULL THEN 'bfs' WHEN question_id IN (SELECT question_id FROM l) THEN '1hop' ELSE '1hop_fallback_bfs' END AS route FROM tg_questions"""


@query("q15_route", ROUTE)
def q15(t):
    links = lk.link_exact(mentions(t), t.tg_entities).select("question_id", F.col("id").alias("node"))
    looked = rt.relation_lookup(links.join(t.tg_questions.select("question_id", "relation_type"), "question_id"), incidence(t))
    return rt.route(t.tg_questions, links, looked).select("question_id", "route")


ROUTED_SEEDS = f"SELECT DISTINCT question_id, id AS node FROM ({EXACT}) JOIN ({ROUTE}) USING (question_id) WHERE route IN ('bfs', '1hop_fallback_bfs')"


# a question without facts is a row without them
@query("q15_routed_facts", f"""{hop_ctes(5, 60, 40, ROUTED_SEEDS)},
routes AS ({ROUTE}),
looked AS (SELECT * FROM (SELECT DISTINCT s.question_id, i.head, i.relation, i.tail, i.evidence FROM ({EXACT}) s JOIN tg_questions q ON q.question_id = s.question_id
    JOIN tg_incidence i ON i.node = s.id AND i.relation = q.relation_type)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail, evidence) <= 60),
walked AS (SELECT DISTINCT question_id, head, relation, tail, evidence FROM ({all_hops(5)})),
scanned AS (SELECT * FROM (SELECT DISTINCT q.question_id, h.name AS head, e.relation_type AS relation, x.name AS tail, e.evidence FROM tg_questions q
    JOIN tg_entities x ON lower(x.name) = lower(q.value) JOIN tg_edges e ON e.tail_id = x.id AND e.relation_type = q.relation_type
    JOIN tg_entities h ON h.id = e.head_id AND h.type = q.entity_type)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail, evidence) <= 60),
facts AS (SELECT '1hop' AS route, * FROM looked UNION ALL SELECT 'bfs', * FROM walked UNION ALL SELECT '1hop_fallback_bfs', * FROM walked UNION ALL SELECT 'property_scan', * FROM scanned)
SELECT question_id, route, head, relation, tail, evidence FROM routes LEFT JOIN facts USING (question_id, route)""")
def q15_facts(t):
    links = lk.link_exact(mentions(t), t.tg_entities)
    routed, facts = rt.retrieve(t.tg_questions, links, incidence(t), g.degrees(t.tg_edges), g.ends_joined(t.tg_edges, t.tg_entities))
    return routed.select("question_id", "route").join(facts.drop("route"), "question_id", "left").select("question_id", "route", "head", "relation", "tail", "evidence")


COS = "round(list_cosine_similarity({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[]), 6)"


# question = vector, its facts = the earlier vectors of the next label
@query("q16_rerank", f"""
WITH f AS (SELECT a.vec_id AS question_id, b.vec_id AS fact_id, count(*) OVER (PARTITION BY a.vec_id) AS n, {COS.format(a='a', b='b')} AS sim
  FROM embeddings a JOIN embeddings b ON b.label = (a.label + 1) % 10 AND b.vec_id < a.vec_id)
SELECT question_id, fact_id, CASE WHEN n > 20 THEN sim END AS similarity FROM f
QUALIFY n <= 20 OR row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, fact_id) <= 20""")
def q16(t):
    e = t.embeddings
    questions = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), F.pmod(F.col("label") + 1, F.lit(10)).alias("of"))
    facts = e.select(F.col("vec_id").alias("fact_id"), F.col("embedding").alias("vector"), F.col("label").alias("of"))
    return rt.rerank(facts, questions, 20).select("question_id", "fact_id", "similarity")


def vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("vector"))


@query("q17_vector_topk", f"""
SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {COS.format(a='a', b='b')} AS similarity, d.source,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a', b='b')} DESC, b.vec_id)::INT AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN documents d ON d.doc_id = b.vec_id WHERE trim(d.text) <> '' QUALIFY rank <= 5""")
def q17(t):
    texts = t.documents.filter("trim(text) <> ''").select(F.col("doc_id").alias("vec_id"), "source")
    index = vectors(t).join(texts, "vec_id")
    queries = vectors(t).withColumnRenamed("vec_id", "query_id")
    found = cosine_topk(queries, index.select("vec_id", "vector"), 5)
    return found.join(texts, "vec_id").select("query_id", "vec_id", "similarity", "source", "rank")


LINE = "'- ' || head || ' -[' || relation || ']-> ' || tail || CASE WHEN evidence <> '' THEN ' (근거: ' || evidence || ')' ELSE '' END"


@query("q18_format_facts", f"""
SELECT question_id, string_agg(line, chr(10) ORDER BY line) AS context FROM (SELECT question_id, {LINE} AS line FROM tg_facts) GROUP BY question_id""")
def q18(t):
    return rt.format_facts(t.tg_facts)


@query("q19_evidence_only", """
SELECT question_id, string_agg(DISTINCT evidence, ' | ' ORDER BY evidence) AS evidence FROM tg_facts WHERE evidence <> '' GROUP BY question_id""")
def q19(t):
    return rt.evidence_only(t.tg_facts).withColumn("evidence", F.array_join("evidence", " | "))


NEAR3 = f"""SELECT a.vec_id AS question_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a', b='b')} DESC, b.vec_id) - 1 AS idx, b.label
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY idx < 3"""
VOTES = f"""
WITH s AS ({NEAR3}), b AS (SELECT question_id, count(DISTINCT label % 4) AS k, arg_min(label % 4, idx) AS first FROM s GROUP BY question_id),
gr AS (SELECT question_id, label // 4 AS gid, count(*) AS c, min(idx) AS idx FROM s WHERE question_id % 11 > 0 GROUP BY ALL),
best AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY c DESC, idx) = 1)
SELECT b.question_id, 'answer ' || CASE WHEN k = 1 OR best.c IS NULL THEN b.first ELSE s.label % 4 END AS answer,
  CASE WHEN k = 1 THEN 3 ELSE coalesce(best.c, 1) END AS votes FROM b LEFT JOIN best ON best.question_id = b.question_id
LEFT JOIN s ON s.question_id = best.question_id AND s.idx = best.idx"""


def votes(t):
    near = cosine_topk(vectors(t).withColumnRenamed("vec_id", "query_id"), vectors(t), 3)
    rows = near.join(t.embeddings.select("vec_id", "label"), "vec_id").select(
        F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("idx"), "label")
    samples = rows.select("question_id", "idx", F.concat(F.lit("answer "), F.col("label") % 4).alias("answer"))
    size = F.when(F.col("question_id") % 11 > 0, 3).otherwise(2)
    groupings = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.floor(F.col("label") / 4).alias("g")))).getField("g").alias("g")) \
        .select("question_id", F.slice("g", F.lit(1), size).alias("group_ids"))
    return rt.majority_vote(samples, groupings)


@query("q20_majority_vote", VOTES)
def q20(t):
    return votes(t).select("question_id", "answer", "votes")


@query("q21_weak_consensus", f"SELECT question_id, votes, 2 * votes < 3 AS weak FROM ({VOTES})")
def q21(t):
    return votes(t).select("question_id", "votes", rt.weak_consensus().alias("weak"))


DISTANCE = """
WITH RECURSIVE a AS (SELECT DISTINCT question_id, head AS x, tail AS y FROM tg_facts UNION SELECT question_id, tail, head FROM tg_facts),
d(question_id, name, distance) AS (SELECT c_custkey, c_name, 0 FROM customer UNION SELECT d.question_id, a.y, distance + 1 FROM d JOIN a ON a.question_id = d.question_id AND a.x = d.name WHERE distance < 4),
dist AS (SELECT question_id, name, min(distance) AS distance FROM d GROUP BY question_id, name)"""


def distances(t):
    return rt.hop_distance(t.tg_facts, t.customer.select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("name")))


@query("q22_hop_distance", f"{DISTANCE} SELECT question_id, name, distance FROM dist")
def q22(t):
    return distances(t)


@query("q23_relevance", f"""{DISTANCE}
SELECT question_id, head, relation, tail, r AS relevance, r >= 0.7 AS near FROM (SELECT f.question_id, head, relation, tail,
  least(CASE WHEN h.distance <= 1 THEN 1.0 WHEN h.distance = 2 THEN 0.7 ELSE 0.45 END, CASE WHEN x.distance <= 1 THEN 1.0 WHEN x.distance = 2 THEN 0.7 ELSE 0.45 END)::DOUBLE AS r
FROM tg_facts f LEFT JOIN dist h ON h.question_id = f.question_id AND h.name = f.head LEFT JOIN dist x ON x.question_id = f.question_id AND x.name = f.tail)""")
def q23(t):
    return rt.relevance(t.tg_facts, distances(t)).drop("evidence")


@query("q24_cited_names", """
SELECT DISTINCT question_id, name FROM (SELECT question_id, head AS name FROM tg_facts UNION SELECT question_id, tail FROM tg_facts) n
JOIN customer ON c_custkey = question_id WHERE contains(c_name || ' lies in NATION_' || c_nationkey || ', segment ' || c_mktsegment, name)""")
def q24(t):
    nodes = t.tg_facts.select("question_id", F.explode(F.array("head", "tail")).alias("name"))
    answers = t.customer.select(F.col("c_custkey").alias("question_id"), F.concat(
        "c_name", F.lit(" lies in NATION_"), "c_nationkey", F.lit(", segment "), "c_mktsegment").alias("answer"))
    return rt.cited_names(answers, nodes)


ENRICHED = """
SELECT f.question_id, f.head, f.relation, f.tail, coalesce(h.kind, 'MISC') AS head_type, coalesce(x.kind, 'MISC') AS tail_type, s.evidence_source FROM tg_facts f
LEFT JOIN (SELECT name, min(type) AS kind FROM tg_entities GROUP BY name) h ON h.name = f.head
LEFT JOIN (SELECT name, min(type) AS kind FROM tg_entities GROUP BY name) x ON x.name = f.tail
LEFT JOIN (SELECT a.name AS head, e.relation_type AS relation, b.name AS tail, arg_min(e.evidence_source, e.document) AS evidence_source
  FROM tg_edges e JOIN tg_entities a ON a.id = e.head_id JOIN tg_entities b ON b.id = e.tail_id GROUP BY ALL) s
ON s.head = f.head AND s.relation = f.relation AND s.tail = f.tail"""


def enriched(t):
    return rt.enrich(t.tg_facts, t.tg_entities, g.ends_joined(t.tg_edges, t.tg_entities)).drop("evidence")


@query("q25_enrich", ENRICHED)
def q25(t):
    return enriched(t)


# every question asks for its customer and for a misspelt or exact nation
@query("q26_all_exact", """
SELECT c_custkey AS question_id, c_nationkey < 12 AS all_exact FROM customer""")
def q26(t):
    nation = F.concat(F.lit("nation_"), "c_nationkey")
    asked = t.customer.select(F.col("c_custkey").alias("question_id"), F.explode(F.array(
        "c_name", F.when(F.col("c_nationkey") < 12, nation).otherwise(F.concat(nation, F.lit("x"))))).alias("mention"))
    return rt.all_exact(asked, lk.link_exact(asked, t.tg_entities))


@query("q27_result_summary", f"""
WITH e AS ({ENRICHED}), n AS (SELECT question_id, head AS name, head_type AS type FROM e UNION SELECT question_id, tail, tail_type FROM e)
SELECT n.question_id, n.type, count(*) AS n_nodes, string_agg(name, ', ' ORDER BY name) AS names, max(f.c) AS n_facts FROM n
JOIN (SELECT question_id, count(*) AS c FROM e GROUP BY question_id) f ON f.question_id = n.question_id GROUP BY n.question_id, n.type""")
def q27(t):
    return rt.result_summary(enriched(t))


# the memo holds the answers of earlier conversation turns by (role, text)
@query("q28_memo", """
WITH k AS (SELECT conv_id, turn, sha1('["' || role || '","' || conv_id % 50 || '"]') AS key FROM conversations),
m AS (SELECT key, cast(min(conv_id) AS varchar) AS value FROM k WHERE turn = 0 GROUP BY key)
SELECT 'known' AS state, conv_id, turn, k.key, value FROM k JOIN m ON m.key = k.key
UNION ALL SELECT 'unknown', min(conv_id), -1, key, NULL FROM k WHERE key NOT IN (SELECT key FROM m) GROUP BY key""")
def q28(t):
    turns = t.conversations.select("conv_id", "turn", "role", (F.col("conv_id") % 50).alias("slot"))
    keyed = turns.withColumn("key", rt.memo_key("role", "slot"))
    memo = keyed.filter("turn = 0").groupBy("key").agg(F.min("conv_id").cast("string").alias("value"))
    known, unknown = rt.memo_split(turns, memo, ["role", "slot"])
    first = keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    missing = unknown.select("key").join(first, "key").select(
        F.lit("unknown").alias("state"), "conv_id", F.lit(-1).cast("bigint").alias("turn"), "key", F.lit(None).cast("string").alias("value"))
    return known.select(F.lit("known").alias("state"), "conv_id", "turn", "key", "value").unionByName(missing)


@query("q28_memo_stats", """
SELECT count(*) AS entries, sum(octet_length(encode(v)))::BIGINT AS bytes FROM (
  SELECT sha1('["' || conv_id || '","' || turn || '"]') AS key, text AS v FROM conversations)""")
def q28_stats(t):
    memo = t.conversations.select(rt.memo_key("conv_id", "turn").alias("key"), F.col("text").alias("value"))
    return rt.memo_stats(memo)
