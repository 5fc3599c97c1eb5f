"""Source, sink and graph-construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import joined, readable_relation, relation_slug
from factloom.operators import docmodel as dm
from factloom.operators import evidence as ev
from factloom.operators import graph as g
from factloom.plans.docmodel_queries import text_sentences
from factloom.plans.evidence_queries import PRED_RESOLVED, decoded, prediction_rows, resolved
from factloom.plans.registry import query
from factloom.session import shared_folder
from factloom.sources import readers, snapshots, writers

SLUG = "upper(trim(regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g'), '_'))"
JOINED_EDGE = """e.head_id, ch.name AS head_name, ch.type AS head_type, e.relation_id, e.relation_name, e.tail_id,
  ct.name AS tail_name, ct.type AS tail_type, e.confidence, e.split, e.document, e.label_no, e.sentence_id, e.texts, e.evidence_source, e.is_revised"""
EDGES_NAMED = f"""SELECT {JOINED_EDGE} FROM gold_edges e
  JOIN (SELECT DISTINCT name || '::' || type AS id, name, type FROM canon) ch ON ch.id = e.head_id
  JOIN (SELECT DISTINCT name || '::' || type AS id, name, type FROM canon) ct ON ct.id = e.tail_id"""


def corpus_entities(t):
    return g.build_entities(t.oc_mentions, dm.canonical(t.oc_mentions))


def corpus_edges(t):
    ids = g.with_entity_ids(dm.canonical(t.oc_mentions))
    labs = ev.resolve_evidence(t.oc_label_rows(), t.oc_mentions, ids)
    return g.build_edges(labs, t.rel_info, t.oc_splits, t.oc_sentence_rows())


@query("s3_relation_names", """
SELECT doc, label_no, code, coalesce(name, code) AS relation_name
FROM (SELECT doc, label_no, CASE WHEN h % 2 = 0 THEN r ELSE r || 'x' END AS code FROM oc_labels) l LEFT JOIN rel_info i USING (code)""")
def s3(t):
    codes = t.oc_labels.select("doc", "label_no", F.when(F.col("h") % 2 == 0, F.col("r")).otherwise(F.concat("r", F.lit("x"))).alias("code"))
    return g.with_relation_name(codes, t.rel_info, "code").select("doc", "label_no", "code", "relation_name")


@query("s4_class_ids", """
SELECT 'Na' AS code, 0 AS class_id UNION ALL SELECT p_brand, row_number() OVER (ORDER BY p_brand)::INT FROM (SELECT DISTINCT p_brand FROM part)""")
def s4(t):
    return readers.class_ids(t.part.select(F.col("p_brand").alias("code")))


@query("s5_normalised_labels", """
SELECT doc, label_no, l.r AS relation_id, h AS head, t AS tail, coalesce(name, l.r) AS relation_text FROM oc_labels l LEFT JOIN rel_info ON code = l.r""")
def s5(t):
    out = readers.normalise_labels(t.docs(), t.rel_info)
    return out.select("doc", F.posexplode("labels").alias("label_no", "l")).select(
        "doc", "label_no", "l.relation_id", "l.head", "l.tail", "l.relation_text")


@query("s6_sentences", """
SELECT doc_id, pos, sentence, 'train_revised' AS split FROM tx_sentences
UNION ALL SELECT doc, sent_id, text, 'dev_revised' FROM oc_sentences""")
def s6(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    a = readers.keep_sentences(lines).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence", F.lit("train_revised").alias("split"))
    b = t.oc_sentence_rows().select(F.col("doc").alias("doc_id"), F.col("sent_id").cast("bigint").alias("pos"),
                                    F.col("text").alias("sentence"), F.lit("dev_revised").alias("split"))
    return a.unionByName(readers.keep_sentences(b))


@query("s9_unknown_docs", """
SELECT DISTINCT o_orderkey AS doc FROM orders WHERE o_orderkey NOT IN (SELECT doc FROM oc_items)""")
def s9(t):
    return readers.unknown_docs(t.orders.select(F.col("o_orderkey").alias("doc")), t.oc_items)


@query("s10_flat_triples", f"""
SELECT head_id, head_name, head_type, relation_id, relation_name, {SLUG.format(c='relation_name')} AS relation_type, tail_id, tail_name, tail_type,
  confidence, split, cast(document AS varchar) AS document, array_to_string(sentence_id, '; ') AS sentence_id, coalesce(array_to_string(texts, ' | '), '') AS evidence,
  evidence_source, is_revised FROM ({EDGES_NAMED})""")
def s10(t):
    path = shared_folder(t.spark, "flat")
    writers.write_csv(writers.to_flat_triples(corpus_edges(t), corpus_entities(t)), path)
    return readers.read_flat_triples(t.spark, path)


@query("s11_relational_entities", """
SELECT id, name, type, '[' || string_agg(DISTINCT '"' || alias || '"', ',' ORDER BY '"' || alias || '"') || ']' AS aliases FROM (
  SELECT c.name || '::' || c.type AS id, c.name, c.type, m.name AS alias FROM canon c JOIN oc_mentions m ON m.doc = c.doc AND m.entity = c.entity)
GROUP BY id, name, type""")
def s11_entities(t):
    return writers.relational_entities(corpus_entities(t))


@query("s11_relational_relations", """
SELECT row_number() OVER (ORDER BY head_id, relation_id, tail_id, document, label_no) AS id, head_id, tail_id, relation_id, relation_name, confidence,
  split, document, '[' || array_to_string(sentence_id, ',') || ']' AS sentence_id,
  CASE WHEN texts IS NULL THEN '[]' ELSE '["' || array_to_string(texts, '","') || '"]' END AS evidence, evidence_source, is_revised FROM gold_edges""")
def s11_relations(t):
    return writers.relational_relations(corpus_edges(t))


AUDIT_VIEWS = """e AS (SELECT id, name, type FROM tg_entities UNION ALL SELECT id, name, type FROM tg_entities WHERE type = 'TIME'
  UNION ALL SELECT 'x::' || r_name, r_name, 'ZONE' FROM region),
r AS (SELECT head_id, relation_type, tail_id FROM tg_edges UNION ALL SELECT c_name || '::ORG', 'based in', c_mktsegment || '::MISC' FROM customer)"""


@query("s12_audit", f"""
WITH {AUDIT_VIEWS}
SELECT 'entity_key_unique' AS rule, count(*) AS violations FROM (SELECT id FROM e GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'head_exists', count(*) FROM r WHERE head_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'tail_exists', count(*) FROM r WHERE tail_id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'entity_not_null', count(*) FROM e WHERE id IS NULL OR name IS NULL OR type IS NULL
UNION ALL SELECT 'relation_not_null', count(*) FROM r WHERE head_id IS NULL OR tail_id IS NULL OR relation_type IS NULL
UNION ALL SELECT 'entity_type_domain', count(*) FROM e WHERE type NOT IN ('PER','ORG','LOC','TIME','NUM','MISC')
UNION ALL SELECT 'relation_type_name', count(*) FROM r WHERE NOT regexp_full_match(relation_type, '[A-Z][A-Z0-9_]*')""")
def s12(t):
    clean = t.tg_entities
    zones = t.region.select(F.concat(F.lit("x::"), "r_name").alias("id"), F.col("r_name").alias("name"), F.lit("ZONE").alias("type"))
    noisy = clean.unionByName(clean.filter("type = 'TIME'")).unionByName(zones)
    rels = t.tg_edges.select("head_id", "relation_type", "tail_id").unionByName(t.customer.select(
        F.concat("c_name", F.lit("::ORG")).alias("head_id"), F.lit("based in").alias("relation_type"),
        F.concat("c_mktsegment", F.lit("::MISC")).alias("tail_id")))
    return writers.audit(noisy, rels)


@query("s13_vector_records", f"""
SELECT concat_ws('::', split, document, head_id, relation_id, tail_id) AS id,
  CASE WHEN texts IS NOT NULL THEN array_to_string(texts, ' ') ELSE head_name || ' ' || relation_name || ' ' || tail_name END AS text,
  head_type, tail_type, array_to_string(sentence_id, ',') AS sentence_id, evidence_source, is_revised FROM ({EDGES_NAMED})""")
def s13(t):
    return writers.to_vector_records(corpus_edges(t), corpus_entities(t)).select(
        "id", "text", "metadata.head_type", "metadata.tail_type", F.array_join("metadata.sentence_id", ",").alias("sentence_id"),
        "metadata.evidence_source", "metadata.is_revised")


@query("s14_hashed_ids", """
SELECT sha1(doc_id || '::' || pos) AS id, doc_id || '::' || pos AS original_id, sentence AS text FROM tx_sentences""")
def s14(t):
    original = F.concat_ws("::", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
    return text_sentences(t).select(writers.hashed_id(original).alias("id"), original.alias("original_id"), F.col("sentence").alias("text"))


@query("s15_raw_triples", """
SELECT e.doc, e.label_no, 'E' || e.h AS head_id, ch.name AS head_name, e.r AS relation_id, coalesce(ri.name, e.r) AS relation_name,
  'E' || e.t AS tail_id, ct.type AS tail_type, array_to_string(e.ids, ',') AS sentence_id, e.source AS evidence_source
FROM resolved e JOIN canon ch ON ch.doc = e.doc AND ch.entity = e.h JOIN canon ct ON ct.doc = e.doc AND ct.entity = e.t LEFT JOIN rel_info ri ON ri.code = e.r""")
def s15(t):
    labs = ev.with_evidence_text(resolved(t), ["doc", "label_no"], t.oc_sentence_rows())
    raw = writers.to_raw_triples(labs, dm.canonical(t.oc_mentions), t.rel_info)
    return raw.select("doc", "label_no", F.col("head.id").alias("head_id"), F.col("head.name").alias("head_name"),
                      F.col("relation.id").alias("relation_id"), F.col("relation.name").alias("relation_name"), F.col("tail.id").alias("tail_id"),
                      F.col("tail.type").alias("tail_type"), joined(F.col("sentence_id")).alias("sentence_id"), "evidence_source")


@query("s16_filled_predictions", f"""
SELECT p.doc, p.label_no, array_to_string(p.ids, ',') AS sentence_id, p.source AS evidence_source,
  coalesce(array_to_string(p.stored_texts, ' | '), v.texts, '') AS evidence FROM ({PRED_RESOLVED}) p
LEFT JOIN (SELECT u.doc, u.label_no, string_agg(x.text, ' | ' ORDER BY u.pos) AS texts FROM (
    SELECT doc, label_no, unnest(ids) AS sent_id, generate_subscripts(ids, 1) AS pos FROM ({PRED_RESOLVED})) u
  JOIN oc_sentences x ON x.doc = u.doc AND x.sent_id = u.sent_id GROUP BY u.doc, u.label_no) v ON v.doc = p.doc AND v.label_no = p.label_no""")
def s16(t):
    rows = ev.resolve_prediction_evidence(prediction_rows(t), t.oc_mentions)
    key = F.concat_ws("#", "doc", "label_no")
    origin = ev.with_evidence_text(rows, ["doc", "label_no"], t.oc_sentence_rows()).select(key.alias("key"), "ids", "texts", F.col("source").alias("origin"))
    triples = prediction_rows(t).select("doc", "label_no", key.alias("key"), F.col("stored_texts").alias("evidence"), "evidence_source", F.struct(
        F.col("doc").cast("string").alias("document_id"), F.col("evidence").alias("sentence_id"), F.lit(False).alias("is_revised")).alias("source"))
    return writers.fill_prediction_evidence(triples, origin, "key").select(
        "doc", "label_no", joined(F.col("source.sentence_id")).alias("sentence_id"), "evidence_source", F.array_join("evidence", " | ").alias("evidence"))


@query("s17_pack_batches", """
SELECT pos // 500 AS batch, count(*) AS n, string_agg(evidence, chr(10) ORDER BY pos) AS text FROM (
  SELECT evidence, row_number() OVER (ORDER BY relation_type, head_id, tail_id, document) - 1 AS pos FROM tg_edges) GROUP BY batch""")
def s17(t):
    return writers.pack_batches(t.tg_edges, 500, ["relation_type", "head_id", "tail_id", "document"], "evidence")


@query("s18_rebuild_then_overlay", """
SELECT head_id, relation_type, tail_id, document, CASE WHEN relation_type = 'MANUFACTURER' THEN 0.25e0 ELSE confidence END AS confidence FROM tg_edges
UNION ALL SELECT c_name || '::ORG', 'SEGMENT', c_mktsegment || '::MISC', 'customer-' || c_custkey, 0.4e0 FROM customer""")
def s18(t):
    """All edges, then an overlay of one relation type again and of a new one; buckets of the other types stay as they were written first."""
    path = shared_folder(t.spark, "graph")
    seq = F.xxhash64(*g.EDGE_KEY)
    base = t.tg_edges.select(*g.EDGE_KEY, "confidence").withColumn("seq", seq)
    snapshots.write_graph(t.tg_entities, base, path, "rebuild")
    update = base.filter("relation_type = 'MANUFACTURER'").withColumn("confidence", F.lit(0.25))
    extra = t.customer.select(F.concat("c_name", F.lit("::ORG")).alias("head_id"), F.lit("SEGMENT").alias("relation_type"),
                              F.concat("c_mktsegment", F.lit("::MISC")).alias("tail_id"),
                              F.concat(F.lit("customer-"), "c_custkey").alias("document"), F.lit(0.4).alias("confidence")).withColumn("seq", seq)
    snapshots.write_graph(t.tg_entities, update.unionByName(extra), path, "overlay")
    return snapshots.read_graph(t.spark, path)[1].drop("seq")


@query("g1_global_entity_id", "SELECT doc, entity, name || '::' || type AS id FROM canon")
def g1(t):
    return g.with_entity_ids(dm.canonical(t.oc_mentions)).select("doc", "entity", "id")


@query("g2_build_entities", """
SELECT id, name, type, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM (
  SELECT c.name || '::' || c.type AS id, c.name, c.type, m.name AS alias FROM canon c JOIN oc_mentions m ON m.doc = c.doc AND m.entity = c.entity)
GROUP BY id, name, type""")
def g2(t):
    return corpus_entities(t).withColumn("aliases", joined(F.col("aliases")))


@query("g3_build_edges", f"""
SELECT head_id, tail_id, relation_id, relation_name, {SLUG.format(c='relation_name')} AS relation_type, confidence, split, document, label_no,
  array_to_string(sentence_id, ',') AS sentence_id, coalesce(array_to_string(texts, ' | '), '') AS evidence, evidence_source, is_revised FROM gold_edges""")
def g3(t):
    return corpus_edges(t).withColumn("sentence_id", joined(F.col("sentence_id"))).withColumn("evidence", F.array_join("evidence", " | "))


PRED_EDGES = """
SELECT head_id, tail_id, relation_id, relation_name, confidence, document, array_to_string(ids, ',') AS sentence_id, evidence_source,
  array_to_string(list_transform(ids, lambda x: all_texts[x + 1]), ' | ') AS evidence FROM (
  SELECT ch.name || '::' || ch.type AS head_id, ct.name || '::' || ct.type AS tail_id, p.r AS relation_id, coalesce(ri.name, p.r) AS relation_name,
    round(1 / (1 + exp(-p.margin)), 4) AS confidence, p.doc AS document,
    CASE WHEN len(list_intersect(a.sents, b.sents)) > 0 THEN list_sort(list_intersect(a.sents, b.sents))
      ELSE list_sort(list_distinct(list_concat(a.sents, b.sents))) END AS ids,
    CASE WHEN len(list_intersect(a.sents, b.sents)) > 0 THEN 'inferred_cooccurrence' ELSE 'inferred_mention_union' END AS evidence_source
  FROM decoded_a p JOIN canon ch ON ch.doc = p.doc AND ch.entity = p.h JOIN canon ct ON ct.doc = p.doc AND ct.entity = p.t
  JOIN ent_sents a ON a.doc = p.doc AND a.entity = p.h JOIN ent_sents b ON b.doc = p.doc AND b.entity = p.t LEFT JOIN rel_info ri ON ri.code = p.r) e
JOIN (SELECT doc, list(text ORDER BY sent_id) AS all_texts FROM oc_sentences GROUP BY doc) x ON x.doc = e.document"""


def prediction_edges(t):
    from factloom.operators.postproc import confidence, confidence_band
    preds = decoded(t).select("doc", "h", "t", "r", confidence(F.col("margin")).alias("confidence"),
                              dm.empty_ints().alias("evidence"), F.lit(None).cast("string").alias("evidence_source"))
    rows = ev.resolve_prediction_evidence(preds, t.oc_mentions, g.with_entity_ids(dm.canonical(t.oc_mentions)))
    band = confidence_band(F.col("confidence"), 0.95, 0.80)
    rows = rows.withColumn("band", band).withColumn("action", F.when(F.col("band") == "high", "pass"))
    return g.build_prediction_edges(rows, t.rel_info, "run-a", t.oc_sentence_rows())


@query("g4_prediction_edges", f"""
SELECT *, CASE WHEN confidence >= 0.95 THEN 'high' WHEN confidence >= 0.8 THEN 'mid' ELSE 'low' END AS filter_band, 'run-a' AS model FROM ({PRED_EDGES})""")
def g4(t):
    return prediction_edges(t).select("head_id", "tail_id", "relation_id", "relation_name", "confidence", "document",
                                      joined(F.col("sentence_id")).alias("sentence_id"), "evidence_source",
                                      F.array_join("evidence", " | ").alias("evidence"), "filter_band", "model")


@query("g5_relation_slug", f"""
SELECT p_partkey, CASE WHEN slug = '' OR slug[1:1] BETWEEN '0' AND '9' THEN 'REL_' || slug ELSE slug END AS slug FROM (
  SELECT p_partkey, {SLUG.format(c="p_size || ' ' || p_name")} AS slug FROM part WHERE p_size < 10
  UNION ALL SELECT p_partkey, {SLUG.format(c="'(' || p_name || ') / ' || p_type || '-' || p_brand")} FROM part WHERE p_size >= 10)""")
def g5(t):
    raw = F.when(F.col("p_size") < 10, F.concat_ws(" ", "p_size", "p_name")).otherwise(
        F.concat(F.lit("("), "p_name", F.lit(") / "), "p_type", F.lit("-"), "p_brand"))
    return t.part.select("p_partkey", relation_slug(raw).alias("slug"))


@query("g6_readable_relation", """
SELECT p_partkey, translate(lower(trim(' ' || p_name || ' / ' || p_type || '-' || p_brand || ' ')), ' -/', '___') AS name FROM part""")
def g6(t):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_type", F.lit("-"), "p_brand", F.lit(" "))
    return t.part.select("p_partkey", readable_relation(raw).alias("name"))


# gold edges, then the same run again together with predicted edges: predictions overwrite gold on equal keys
@query("g7_upsert_edges", f"""
SELECT head_id, relation_name, tail_id, document, confidence, evidence_source, evidence FROM (
  SELECT head_id, relation_name, tail_id, document, confidence, evidence_source, coalesce(array_to_string(texts, ' | '), '') AS evidence, 0 AS batch, label_no AS seq FROM gold_edges
  UNION ALL SELECT head_id, relation_name, tail_id, document, confidence, evidence_source, evidence, 1, 1000000 * confidence + 0 FROM ({PRED_EDGES}))
QUALIFY row_number() OVER (PARTITION BY head_id, relation_name, tail_id, document ORDER BY batch DESC, seq DESC, evidence_source DESC, evidence DESC) = 1""")
def g7(t):
    cols = [*g.EDGE_KEY, "relation_name", "confidence", "evidence_source", F.array_join("evidence", " | ").alias("evidence")]
    last = F.struct("n", "evidence_source", "evidence").alias("seq")
    gold = corpus_edges(t).select(*cols, F.col("label_no").cast("double").alias("n")).select("*", last).drop("n")
    preds = prediction_edges(t).select(*cols, (1e6 * F.col("confidence")).alias("n")).select("*", last).drop("n")
    preds = t.kept_by_doc(preds, "document", "predicted")  # both upserts read them
    once = g.upsert_edges(gold, preds)
    twice = g.upsert_edges(once, preds)
    return twice.select("head_id", "relation_name", "tail_id", "document", "confidence", "evidence_source", "evidence")


@query("g8_upsert_entities", """
SELECT id, name, CASE WHEN id IN (SELECT s_name || '::ORG' FROM supplier) THEN 'PER' ELSE type END AS type FROM tg_entities
UNION ALL SELECT s_name || '::NEW', s_name, 'NUM' FROM supplier""")
def g8(t):
    base = t.tg_entities
    retyped = t.supplier.select(F.concat("s_name", F.lit("::ORG")).alias("id"), F.col("s_name").alias("name"), F.lit("PER").alias("type"))
    added = t.supplier.select(F.concat("s_name", F.lit("::NEW")).alias("id"), F.col("s_name").alias("name"), F.lit("NUM").alias("type"))
    return g.upsert_entities(base, retyped.unionByName(added))


@query("g9_orphans", """
SELECT id, name, type FROM tg_entities WHERE id NOT IN (SELECT head_id FROM tg_edges UNION SELECT tail_id FROM tg_edges)""")
def g9(t):
    return g.orphans(t.tg_entities, t.tg_edges)


@query("g10_overlay_stats", f"""
WITH b AS (SELECT DISTINCT head_id AS id FROM gold_edges UNION SELECT tail_id FROM gold_edges),
n AS (SELECT DISTINCT head_id AS id FROM ({PRED_EDGES}) UNION SELECT tail_id FROM ({PRED_EDGES}))
SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM b)) AS added, (SELECT count(*) FROM n WHERE id IN (SELECT id FROM b)) AS merged,
  (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM n)) AS untouched""")
def g10(t):
    ids = lambda e: e.select(F.explode(F.array("head_id", "tail_id")).alias("id")).distinct()
    return g.overlay_stats(ids(corpus_edges(t)), ids(prediction_edges(t)))


@query("g11_graph_stats", """
SELECT 'entity_type' AS kind, type AS key, count(*) AS n FROM tg_entities GROUP BY type
UNION ALL SELECT 'relation_type', relation_type, count(*) FROM tg_edges GROUP BY relation_type
UNION ALL SELECT 'documents', 'all', count(DISTINCT document) FROM tg_edges""")
def g11(t):
    return g.graph_stats(t.tg_entities, t.tg_edges)


@query("g12_degrees", "SELECT id, degree FROM tg_degree")
def g12(t):
    return g.degrees(t.tg_edges)


@query("g13_incidence", "SELECT node, head, relation, tail, evidence, next_id FROM tg_incidence")
def g13(t):
    return g.incidence(t.tg_edges, t.tg_entities)
