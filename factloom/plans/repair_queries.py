"""Graph-repair queries over the trade graph. External verdicts are stand-ins derived from a hash of the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import value_key
from factloom.operators import docmodel as dm
from factloom.operators import graph as g
from factloom.operators import repair as rp
from factloom.plans.registry import query

YEAR_KEY = """CASE WHEN regexp_extract({c}, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1) <> '' THEN 'year:' || regexp_extract({c}, '\\b(1[0-9]{{3}}|20[0-9]{{2}})\\b', 1)
  ELSE 'raw:' || {c} END"""


def said_yes(key: str) -> str:
    return f"ascii(substr(md5({key}), 1, 1)) % 3 <> 0"


def said_yes_col(key):
    return F.ascii(F.substring(F.md5(key), 1, 1)) % 3 != 0


@query("r1_value_key", f"SELECT id, {YEAR_KEY.format(c='name')} AS key FROM tg_entities")
def r1(t):
    return t.tg_entities.select("id", value_key(F.col("name")).alias("key"))


def named(t):
    return g.ends_joined(t.tg_edges, t.tg_entities)


OCC = """SELECT e.head_id AS id, e.relation_type, e.document, min(t.name) AS value FROM tg_edges e JOIN tg_entities t ON t.id = e.tail_id
  WHERE e.relation_type = 'INCEPTION' GROUP BY ALL"""


@query("r2_conflict_candidates", f"""
SELECT id, relation_type, count(DISTINCT {YEAR_KEY.format(c='value')}) AS n_keys, count(*) AS n_documents FROM ({OCC}) GROUP BY id, relation_type HAVING n_keys >= 2""")
def r2(t):
    return rp.conflict_candidates(named(t)).withColumn("n_documents", F.col("n_documents").cast("bigint"))


# verdict: documents of one decade belong together; names starting with b got one answer too few
def judged_groups(t):
    occ = rp.occurrences(named(t))
    decade = F.floor(F.regexp_extract("value", "([0-9]{4})", 1).cast("int") / 10).cast("int")
    packed = occ.groupBy("id", "relation_type").agg(F.sort_array(F.collect_list(F.struct("document", decade.alias("gid")))).alias("o"))
    cands = packed.select("id", "relation_type", F.col("o.document").alias("documents"))
    gids = F.when(F.col("id").startswith("b"), F.slice("o.gid", F.lit(1), F.size("o") - 1)).otherwise(F.col("o.gid"))
    return rp.valid_groups(cands, packed.select("id", "relation_type", gids.alias("group_ids")))


@query("r4_valid_groups", "SELECT id, relation_type, document, gid FROM split_groups")
def r4(t):
    return judged_groups(t)


TARGETS = f"""SELECT x.id, x.document, CASE WHEN x.gid = k.keep THEN x.id ELSE x.id || '#' || trim(regexp_replace(f.first, '[^A-Za-z0-9]+', '_', 'g'), '_') END AS new_id
  FROM split_groups x JOIN (SELECT id, min(gid) AS keep FROM split_groups GROUP BY id) k ON k.id = x.id
  JOIN (SELECT id, gid, min(document) AS first FROM split_groups GROUP BY id, gid) f ON f.id = x.id AND f.gid = x.gid"""


@query("r3_split_edges", f"""
WITH m AS ({TARGETS}) SELECT coalesce(a.new_id, e.head_id) AS head_id, e.relation_type, coalesce(b.new_id, e.tail_id) AS tail_id, e.document FROM tg_edges e
LEFT JOIN m a ON a.id = e.head_id AND a.document = e.document LEFT JOIN m b ON b.id = e.tail_id AND b.document = e.document""")
def r3(t):
    edges = rp.split_entities(t.tg_entities, t.tg_edges, judged_groups(t))[1]
    return edges.select("head_id", "relation_type", "tail_id", "document")


@query("r3_split_entities", f"""
SELECT id, name, type FROM tg_entities UNION ALL SELECT DISTINCT new_id, name, type FROM ({TARGETS}) m JOIN tg_entities e ON e.id = m.id WHERE new_id <> m.id""")
def r3_entities(t):
    return rp.split_entities(t.tg_entities, t.tg_edges, judged_groups(t))[0]


CANDS = """SELECT s.id AS short_id, s.name AS short_name, l.id AS long_id, l.name AS long_name FROM tg_entities l JOIN tg_entities s
  ON s.type = 'ORG' AND l.type = 'ORG' AND s.name = regexp_replace(l.name, '\\s+(?:Inc\\.?|Ltd\\.?)$', '') AND s.name <> l.name"""


@query("r5_suffix_candidates", CANDS)
def r5(t):
    return rp.suffix_candidates(t.tg_entities)


GATED = f"""SELECT c.*, CASE WHEN h.document IS NULL THEN 'open' WHEN short_name = 'Supplier#000000003' THEN 'override' ELSE 'reject' END AS gate FROM ({CANDS}) c
  LEFT JOIN tg_edges h ON h.relation_type = 'SUBSIDIARY' AND h.head_id = short_id AND h.tail_id = long_id"""
OVERRIDE = [("Supplier#000000003", "Supplier#000000003 Inc.")]


def gated(t):
    return rp.topology_gate(rp.suffix_candidates(t.tg_entities), t.tg_edges, OVERRIDE)


@query("r6_topology_gate", GATED)
def r6(t):
    return gated(t)


VERDICT = f"""
WITH g AS ({GATED}), n AS (SELECT DISTINCT node, relation, CASE WHEN i.next_id = e.id THEN e.name END AS name FROM tg_incidence i JOIN tg_entities e ON e.id = i.next_id),
s AS (SELECT short_id, long_id, a.relation, a.name AS an, b.name AS bn FROM g JOIN n a ON a.node = short_id JOIN n b ON b.node = long_id AND b.relation = a.relation),
p AS (SELECT short_id, long_id, relation, max((an = bn)::INT) AS agrees FROM s GROUP BY ALL),
q AS (SELECT short_id, long_id, max(agrees) AS agree, max(CASE WHEN relation = 'COUNTRY' AND agrees = 0 THEN 1 END) AS conflict FROM p GROUP BY ALL),
o AS (SELECT DISTINCT short_id, long_id FROM g JOIN n a ON a.node = short_id JOIN n b ON b.node = long_id AND b.name = a.name)
SELECT g.short_id, g.long_id, gate, CASE WHEN conflict = 1 THEN 'reject' WHEN agree = 1 THEN 'merge' WHEN o.short_id IS NOT NULL THEN 'merge' ELSE 'undecided' END AS verdict
FROM g LEFT JOIN q ON q.short_id = g.short_id AND q.long_id = g.long_id LEFT JOIN o ON o.short_id = g.short_id AND o.long_id = g.long_id"""


def neighbours(t):
    names = t.tg_entities.select(F.col("id").alias("next_id"), "name")
    return g.incidence(t.tg_edges, t.tg_entities).select("node", "relation", "next_id").distinct().join(names, "next_id")


def verdicts(t):
    return rp.rule_verdict(gated(t), neighbours(t)).select("short_id", "long_id", "gate", "verdict")


@query("r7_rule_verdict", VERDICT)
def r7(t):
    return verdicts(t)


# chains of three spellings per supplier: "A", "A Inc." and "A Ltd."; degrees decide, ties by name length
CHAIN = """SELECT s_name || '::ORG' AS a, s_name || ' Inc.::ORG' AS b FROM supplier WHERE s_acctbal < 4000
  UNION ALL SELECT s_name || ' Inc.::ORG', s_name || ' Ltd.::ORG' FROM supplier WHERE s_acctbal < 2500
  UNION ALL SELECT s_name || ' Ltd.::ORG', s_name || ' Limited::ORG' FROM supplier WHERE s_acctbal < 2000"""
PLAN = f"""SELECT n.id AS drop_id, k.keep_id FROM (SELECT a AS id, regexp_extract(a, '^(Supplier#[0-9]+)', 1) AS base FROM ({CHAIN}) UNION SELECT b, regexp_extract(b, '^(Supplier#[0-9]+)', 1) FROM ({CHAIN})) n
JOIN (SELECT base, arg_max(id, [lpad(coalesce(degree, 0)::VARCHAR, 12, '0'), lpad(length(regexp_replace(id, '::ORG$', ''))::VARCHAR, 12, '0'), id]) AS keep_id FROM (
  SELECT n.id, n.base, d.degree FROM (SELECT a AS id, regexp_extract(a, '^(Supplier#[0-9]+)', 1) AS base FROM ({CHAIN}) UNION SELECT b, regexp_extract(b, '^(Supplier#[0-9]+)', 1) FROM ({CHAIN})) n
  LEFT JOIN tg_degree d ON d.id = n.id) GROUP BY base) k ON k.base = n.base WHERE n.id <> k.keep_id"""


def chain_plan(t):
    pairs = t.sql(CHAIN).toDF("short_id", "long_id")
    nodes = pairs.select(F.explode(F.array("short_id", "long_id")).alias("id")).distinct().withColumn("name", F.regexp_replace("id", "::ORG$", ""))
    return rp.merge_plan(pairs, nodes, g.degrees(t.tg_edges))


@query("r8_merge_plan", PLAN)
def r8(t):
    return chain_plan(t)


def with_aliases(t):
    return t.tg_entities.withColumn("aliases", F.array_distinct(F.array(F.col("name"), F.lower("name"))))


@query("r9_merged_edges", f"""
WITH p AS ({PLAN}) SELECT DISTINCT coalesce(a.keep_id, head_id) AS head_id, relation_type, coalesce(b.keep_id, tail_id) AS tail_id, document FROM tg_edges
LEFT JOIN p a ON a.drop_id = head_id LEFT JOIN p b ON b.drop_id = tail_id""")
def r9(t):
    edges = rp.apply_merges(with_aliases(t), t.tg_edges, chain_plan(t))[1]
    return edges.select("head_id", "relation_type", "tail_id", "document")


@query("r9_merged_pairs", f"""
WITH p AS ({PLAN}) SELECT DISTINCT coalesce(a.keep_id, head_id) AS head_id, relation_type, coalesce(b.keep_id, tail_id) AS tail_id FROM tg_edges
LEFT JOIN p a ON a.drop_id = head_id LEFT JOIN p b ON b.drop_id = tail_id""")
def r9_pairs(t):
    edges = rp.apply_merges(with_aliases(t), t.tg_edges, chain_plan(t), key="pair")[1]
    return edges.select("head_id", "relation_type", "tail_id")


@query("r9_merged_entities", f"""
WITH p AS ({PLAN}), a AS (SELECT coalesce(keep_id, id) AS id, unnest([name, lower(name)]) AS alias FROM tg_entities LEFT JOIN p ON drop_id = id)
SELECT e.id, e.name, e.type, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM tg_entities e JOIN a ON a.id = e.id
WHERE e.id NOT IN (SELECT drop_id FROM p) GROUP BY e.id, e.name, e.type""")
def r9_entities(t):
    entities = rp.apply_merges(with_aliases(t), t.tg_edges, chain_plan(t))[0]
    return entities.withColumn("aliases", F.array_join("aliases", "|"))


EDGE_ID = "md5(head_id || '|' || relation_type || '|' || tail_id || '|' || document)"


def edge_ids(df):
    return df.withColumn("edge_id", F.md5(F.concat_ws("|", "head_id", "relation_type", "tail_id", "document")))


DEMONYM = f"""SELECT {EDGE_ID} AS edge_id, relation_type, 'tail' AS side, n_name || 'n' AS wrong_name, n_name || '::LOC' AS canonical_id, document
  FROM tg_edges JOIN nation ON tail_id = n_name || 'n::LOC' WHERE relation_type IN ('COUNTRY', 'PART_OF')
UNION ALL SELECT {EDGE_ID}, relation_type, 'head', n_name, r_name || '::LOC', document FROM tg_edges JOIN nation ON head_id = n_name || '::LOC'
  JOIN region ON r_regionkey = n_regionkey AND r_regionkey = 2 WHERE relation_type = 'PART_OF'"""


def demonym_cands(t):
    nations = t.nation.select(F.concat("n_name", F.lit("n")).alias("demonym"), F.col("n_name").alias("place"))
    southern = t.nation.join(t.region.filter("r_regionkey = 2"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("demonym"), F.col("r_name").alias("place"))
    edges = edge_ids(named(t))
    plain = rp.demonym_candidates(edges, t.tg_entities, nations)
    heads = rp.demonym_candidates(edges.filter("relation_type = 'PART_OF'"), t.tg_entities, southern)
    return plain.unionByName(heads)


@query("r10_demonym_candidates", DEMONYM)
def r10(t):
    return demonym_cands(t)


@query("r11_repointed_edges", f"""
WITH c AS ({DEMONYM}), y AS (SELECT * FROM c WHERE {said_yes('edge_id')})
SELECT CASE WHEN y.side = 'head' THEN y.canonical_id ELSE head_id END AS head_id, e.relation_type,
  CASE WHEN y.side = 'tail' THEN y.canonical_id ELSE tail_id END AS tail_id, e.document FROM tg_edges e
LEFT JOIN y ON y.edge_id = {EDGE_ID.replace('document', 'e.document').replace('relation_type', 'e.relation_type')}""")
def r11(t):
    cands = demonym_cands(t)
    verdicts_ = cands.select("edge_id", F.when(said_yes_col("edge_id"), "yes").otherwise("no").alias("verdict"))
    edges = edge_ids(t.tg_edges.select("head_id", "relation_type", "tail_id", "document"))
    return rp.repoint(edges, cands, verdicts_)[0].drop("edge_id")


@query("r11_ungrounded", f"SELECT edge_id, side FROM ({DEMONYM}) WHERE NOT ({said_yes('edge_id')})")
def r11_ungrounded(t):
    cands = demonym_cands(t)
    verdicts_ = cands.select("edge_id", F.when(said_yes_col("edge_id"), "yes").otherwise("no").alias("verdict"))
    return rp.repoint(edge_ids(t.tg_edges), cands, verdicts_)[1].select("edge_id", "side")


# raw answers per customer: two words as JSON, three of them malformed kinds by market segment
@query("r12_parse_verdicts", """
SELECT c_custkey AS batch, i AS idx, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'no'
  WHEN i = 0 AND c_acctbal > 3000 THEN 'yes' WHEN i = 1 AND c_mktsegment = 'FURNITURE' THEN 'yes' ELSE 'no' END AS verdict
FROM customer CROSS JOIN (SELECT unnest([0, 1]) AS i)""")
def r12(t):
    first = F.when(F.col("c_acctbal") > 3000, " Yes ").otherwise("maybe")
    second = F.when(F.col("c_mktsegment") == "FURNITURE", "YES").otherwise("yes, surely")
    good = F.to_json(F.array(first, second))
    raw = (F.when(F.col("c_mktsegment") == "BUILDING", F.to_json(F.array(F.lit("yes")))).when(F.col("c_mktsegment") == "MACHINERY", F.lit("[yes"))
           .otherwise(good))
    return rp.parse_verdicts(t.customer.select(F.col("c_custkey").alias("batch"), F.lit(2).alias("n"), raw.alias("raw")))


@query("r13_type_splits", """
SELECT name, count(DISTINCT type) AS n_types, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM canon GROUP BY name HAVING n_types > 1""")
def r13(t):
    return rp.type_split_report(dm.canonical(t.oc_mentions).select("name", "type"))


@query("r14_open_triangles", """
SELECT DISTINCT a.head_id AS a, a.tail_id AS b, b.tail_id AS c FROM tg_edges a JOIN tg_edges b ON b.head_id = a.tail_id AND b.relation_type = 'COUNTRY'
WHERE a.relation_type = 'MANUFACTURER' AND a.head_id <> b.tail_id AND NOT EXISTS (
  SELECT 1 FROM tg_edges c WHERE c.relation_type = 'COUNTRY' AND c.head_id = a.head_id AND c.tail_id = b.tail_id)""")
def r14(t):
    return rp.open_triangles(t.tg_edges, "MANUFACTURER", "COUNTRY", "COUNTRY")


