"""Evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import is_revised, joined, vertex_index
from factloom.functions.vectors import cosine_topk_within
from factloom.operators import evidence as ev
from factloom.operators.docmodel import PAIR, entity_sents
from factloom.plans.docmodel_queries import OFFSETS, rd, sentence_spans, token_weights
from factloom.plans.registry import query
from factloom.schemas import PRUNE_RATES


def resolved(t):
    return ev.resolve_evidence(t.oc_label_rows(), t.oc_mentions)


@query("e1_cooccurrence", """
SELECT l.doc, l.label_no, array_to_string(list_sort(list_intersect(a.sents, b.sents)), ',') AS together FROM oc_labels l
JOIN ent_sents a ON a.doc = l.doc AND a.entity = l.h JOIN ent_sents b ON b.doc = l.doc AND b.entity = l.t""")
def e1(t):
    return ev.cooccurrence(t.oc_label_rows(), t.oc_mentions).select("doc", "label_no", joined(F.col("together")).alias("together"))


@query("e2_evidence_cascade", """
SELECT doc, label_no, h, t, r, array_to_string(ids, ',') AS ids, source FROM resolved""")
def e2(t):
    return resolved(t).select("doc", "label_no", "h", "t", "r", joined(F.col("ids")).alias("ids"), "source")


@query("e3_bridge_sentences", "SELECT doc, h, t, array_to_string(ids, ',') AS bridge FROM bridges")
def e3(t):
    together = ev.cooccurrence(t.oc_label_rows(), t.oc_mentions)
    apart = together.filter("size(together) = 0").select(*PAIR, "hs", "ts").dropDuplicates(PAIR)
    return ev.bridge_sentences(apart, t.oc_mentions).withColumn("bridge", joined(F.col("bridge")))


PRED_ROWS = """
SELECT doc, label_no, h, t, r, evidence_sent, CASE WHEN r = 'P361' AND h % 2 = 0 THEN 'inferred_bridge' END AS stored,
  CASE WHEN h % 3 = 0 AND (evidence_sent IS NOT NULL OR r = 'P176') THEN ['as stated in ' || doc, 'and once more'] END AS stored_texts FROM oc_labels"""
PRED_RESOLVED = f"""
SELECT p.doc, p.label_no, p.h, p.t, p.r, p.stored, p.stored_texts,
  CASE WHEN p.stored IS NOT NULL OR p.evidence_sent IS NOT NULL OR p.stored_texts IS NOT NULL THEN CASE WHEN p.evidence_sent IS NULL THEN [] ELSE [p.evidence_sent] END
    WHEN len(list_intersect(a.sents, b.sents)) > 0 THEN list_sort(list_intersect(a.sents, b.sents))
    ELSE list_sort(list_distinct(list_concat(a.sents, b.sents))) END AS ids,
  CASE WHEN p.stored IS NOT NULL THEN p.stored WHEN p.evidence_sent IS NOT NULL OR p.stored_texts IS NOT NULL THEN 'model_provided'
    WHEN len(list_intersect(a.sents, b.sents)) > 0 THEN 'inferred_cooccurrence' ELSE 'inferred_mention_union' END AS source
FROM ({PRED_ROWS}) p JOIN ent_sents a ON a.doc = p.doc AND a.entity = p.h JOIN ent_sents b ON b.doc = p.doc AND b.entity = p.t"""


def prediction_rows(t):
    stored = F.when((F.col("r") == "P361") & (F.col("h") % 2 == 0), F.lit("inferred_bridge"))
    texts = F.when((F.col("h") % 3 == 0) & ((F.size("evidence") > 0) | (F.col("r") == "P176")),
                   F.array(F.concat(F.lit("as stated in "), F.col("doc")), F.lit("and once more")))
    return t.oc_label_rows().withColumn("evidence_source", stored).withColumn("stored_texts", texts)


@query("e4_prediction_evidence", f"""
SELECT doc, label_no, array_to_string(ids, ',') AS ids, source FROM ({PRED_RESOLVED})""")
def e4(t):
    out = ev.resolve_prediction_evidence(prediction_rows(t), t.oc_mentions)
    return out.select("doc", "label_no", joined(F.col("ids")).alias("ids"), "source")


@query("e5_vertex_index", """
SELECT doc, 'E' || cast(entity AS varchar) AS entity_id, entity AS vertex FROM oc_entities""")
def e5(t):
    ids = t.oc_mentions.select("doc", F.concat(F.lit("E"), F.col("entity")).alias("entity_id")).distinct()
    return ids.withColumn("vertex", vertex_index(F.col("entity_id")))


@query("e6_evidence_text", """
SELECT u.doc, u.label_no, string_agg(x.text, ' | ' ORDER BY u.pos) AS texts FROM (
  SELECT doc, label_no, unnest(ids) AS sent_id, generate_subscripts(ids, 1) AS pos FROM resolved) u
JOIN oc_sentences x ON x.doc = u.doc AND x.sent_id = u.sent_id GROUP BY u.doc, u.label_no""")
def e6(t):
    out = ev.with_evidence_text(resolved(t), ["doc", "label_no"], t.oc_sentence_rows()).filter("size(texts) > 0")
    return out.select("doc", "label_no", F.array_join("texts", " | ").alias("texts"))


@query("e7_revised_flag", "SELECT doc, split, split LIKE '%\\_revised' ESCAPE '\\' AS is_revised FROM oc_splits")
def e7(t):
    return t.oc_splits.withColumn("is_revised", is_revised(F.col("split")))


@query("e8_evidence_source_counts", "SELECT source, count(*) AS n FROM resolved GROUP BY source")
def e8(t):
    return ev.source_counts(resolved(t))


DECODED = "SELECT doc, h, t, r FROM decoded_a"


def decoded(t, column="logit_a", scores=False):
    from factloom.operators.postproc import decode_adaptive
    return decode_adaptive(t.pl_logit_rows(column, scores)).join(t.rel_ids.withColumnRenamed("code", "r"), "class_id")


E9_SQL = """
SELECT p.doc, p.h, p.t, p.r, g.r IS NOT NULL AS is_gold,
  CASE WHEN g.r IS NOT NULL THEN g.ev ELSE coalesce(cast(s.best AS varchar), '') END AS ids
FROM decoded_a p LEFT JOIN (SELECT doc, h, t, r, coalesce(string_agg(DISTINCT evidence_sent, ',' ORDER BY evidence_sent), '') AS ev
  FROM oc_labels GROUP BY doc, h, t, r) g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r
LEFT JOIN (SELECT doc, h, t, sent_id AS best FROM pl_sentence_scores
  QUALIFY row_number() OVER (PARTITION BY doc, h, t ORDER BY score DESC, sent_id) = 1) s ON s.doc = p.doc AND s.h = p.h AND s.t = p.t"""


@query("e9_evidence_for_predictions", E9_SQL)
def e9(t):
    out = ev.evidence_for_predictions(decoded(t, scores=True), t.oc_label_rows())
    return out.select(*PAIR, "r", "is_gold", joined(F.col("ids")).alias("ids"))


@query("e10_select_by_mean", """
SELECT DISTINCT doc, sent_id FROM (SELECT *, avg(score) OVER (PARTITION BY doc, h, t) AS m FROM pl_sentence_scores)
WHERE score >= m - 1e-12""")
def e10(t):
    return ev.select_by_mean(t.pl_sentence_score_rows())


# document = label, sentence = vector: each vector picks the 3 sentences of the next label's document nearest to it
@query("e11_select_topk_cosine", """
SELECT a.vec_id AS query, b.vec_id AS sent_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INT AS rank
FROM embeddings a JOIN embeddings b ON b.label = (a.label + 1) % 10 QUALIFY rank <= 3""")
def e11(t):
    e = t.embeddings
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.pmod(F.col("label") + 1, F.lit(10)).alias("of"))
    sents = e.select("vec_id", F.col("embedding").alias("vector"), F.col("label").alias("of"))
    near = cosine_topk_within(queries, sents, 3)
    return ev.select_topk(near.select(F.col("query_id").alias("query"), F.col("vec_id").alias("sent_id"), "similarity"), 3)


@query("e12_renormalise", """
SELECT doc, sent_id, w, round(CASE WHEN m > 1e-12 THEN CASE WHEN is_evidence THEN score / m ELSE 0 END ELSE score END, 12) AS weight
FROM (SELECT *, sum(CASE WHEN is_evidence THEN score ELSE 0 END) OVER (PARTITION BY doc) AS m FROM oc_token_scores)""")
def e12(t):
    weights = t.oc_token_scores.withColumnRenamed("score", "weight")
    return ev.renormalise(weights, ["doc"], F.col("is_evidence")).select("doc", "sent_id", "w", F.round("weight", 12).alias("weight"))


@query("e13_score_profile", """
SELECT is_evidence, count(*) AS n, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.5), 9) AS median,
  round(quantile_cont(score, 0.1), 9) AS p10, round(quantile_cont(score, 0.9), 9) AS p90 FROM oc_token_scores GROUP BY is_evidence""")
def e13(t):
    out = ev.score_profile(t.oc_token_scores, "score", "is_evidence", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return out.select("is_evidence", "n", *[rd(c).alias(c) for c in ("mean", "median", "p10", "p90")])


@query("e14_prune_impact", """
WITH rates AS (SELECT unnest([0.10, 0.25, 0.50])::DOUBLE AS rate),
cuts AS (SELECT doc, rate, CASE rate WHEN 0.10 THEN quantile_cont(score, 0.10) WHEN 0.25 THEN quantile_cont(score, 0.25)
  ELSE quantile_cont(score, 0.50) END AS cut FROM oc_token_scores CROSS JOIN rates GROUP BY doc, rate),
d AS (SELECT rate, s.doc, avg(CASE WHEN is_evidence THEN (score < cut)::INT END) AS ev, avg(CASE WHEN NOT is_evidence THEN (score < cut)::INT END) AS other
  FROM oc_token_scores s JOIN cuts ON cuts.doc = s.doc GROUP BY rate, s.doc)
SELECT rate, round(avg(ev), 9) AS evidence_dropped, round(avg(other), 9) AS other_dropped, count(ev) AS n_docs FROM d GROUP BY rate""")
def e14(t):
    out = ev.prune_impact(t.oc_token_scores, PRUNE_RATES)
    return out.select("rate", rd("evidence_dropped").alias("evidence_dropped"), rd("other_dropped").alias("other_dropped"), "n_docs")


@query("e15_mann_whitney", """
WITH c AS (SELECT score, count(*) FILTER (is_evidence) AS a, count(*) FILTER (NOT is_evidence) AS b FROM oc_token_scores GROUP BY score),
r AS (SELECT *, coalesce(sum(a + b) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0 AS mr FROM c),
s AS (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2, sum(a * mr)::DOUBLE AS rs, sum(((a+b)::DOUBLE)^3 - (a+b)) AS ties FROM r)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(rs - n1*(n1+1)/2, 2) AS u,
  round((rs - n1*(n1+1)/2 - n1*n2/2) / sqrt(n1*n2/12*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1)))), 9) AS z FROM s""")
def e15(t):
    out = ev.mann_whitney_u(t.oc_token_scores, "score", "is_evidence")
    return out.select("n1", "n2", F.round("u", 2).alias("u"), rd("z").alias("z"))


@query("e16_blend_evidence", f"""
WITH k AS (SELECT s.doc, s.sent_id, o.off + s.w AS position, s.score, o.n_tokens, sum(s.score) OVER (PARTITION BY s.doc) AS total,
  sum(s.score) OVER (PARTITION BY s.doc, s.sent_id) AS mass FROM oc_token_scores s JOIN ({OFFSETS}) o ON o.doc = s.doc AND o.sent_id = s.sent_id),
m AS (SELECT *, 0.4 * score / (total + 1e-30) + 0.6 * (mass / (total + 1e-30)) / n_tokens AS mixed FROM k)
SELECT doc, sent_id, position, round(mixed / (sum(mixed) OVER (PARTITION BY doc) + 1e-30), 12) AS weight FROM m""")
def e16(t):
    spans = sentence_spans(t)
    offsets = spans.select("doc", "sent_id", F.col("start").alias("offset"))
    weights = t.oc_token_scores.join(offsets, ["doc", "sent_id"]).select(
        "doc", "sent_id", (F.col("offset") + F.col("w")).alias("position"), F.col("score").alias("weight"))
    return ev.blend_evidence(weights, spans, ["doc"], 0.6).withColumn("weight", F.round("weight", 12))
