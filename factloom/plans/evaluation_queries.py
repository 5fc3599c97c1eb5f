"""Post-processing, scoring, profiling and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.text import joined
from factloom.operators import docmodel as dm
from factloom.operators import evaluate as ev
from factloom.operators import graph as g
from factloom.operators import postproc as pp
from factloom.operators import profile as pf
from factloom.operators.docmodel import PAIR
from factloom.operators.evidence import evidence_for_predictions, with_evidence_text
from factloom.plans.docmodel_queries import DUCK_TOKENS, rd, text_sentences, text_tokens
from factloom.plans.evidence_queries import decoded
from factloom.plans.registry import query
from factloom.plans.retrieval_queries import COS, vectors
from factloom.schemas import GAMMA_GRID, HIGH_CONFIDENCE, LOW_CONFIDENCE, THRESHOLD_GRID


def rounded(df, *names):
    return df.select(*[rd(c).alias(c) if c in names else F.col(c) for c in df.columns])


def logits(t, column="logit_a"):
    """One row per class."""
    return t.pl_logit_rows(column).select(*PAIR, F.posexplode("logits").alias("class_id", "logit"))


# --- post-processing ---------------------------------------------------------------------------------------------
CAPPED = """SELECT doc, h, t, class_id FROM (SELECT *, max(CASE WHEN class_id = 0 THEN logit_a END) OVER w AS th,
    rank() OVER (PARTITION BY doc, h, t ORDER BY logit_a DESC) AS rk FROM pl_logits WINDOW w AS (PARTITION BY doc, h, t))
  WHERE class_id > 0 AND logit_a > th AND rk <= 2"""


@query("m1_decode_adaptive", f"""
SELECT doc, h, t, class_id FROM ({CAPPED}) UNION ALL
SELECT doc, h, t, 0 FROM pl_pairs p WHERE NOT EXISTS (SELECT 1 FROM ({CAPPED}) d WHERE d.doc = p.doc AND d.h = p.h AND d.t = p.t)""")
def m1(t):
    return pp.decode_adaptive(t.pl_logit_rows("logit_a"), 2, na=True).drop("margin")


@query("m2_decode_sigmoid", """
SELECT doc, h, t, class_id FROM (SELECT *, rank() OVER (PARTITION BY doc, h, t ORDER BY logit_a - 9 DESC) AS rk FROM pl_logits)
WHERE class_id > 0 AND 1 / (1 + exp(-(logit_a - 9))) > 0.6 AND rk <= 3""")
def m2(t):
    return pp.decode_sigmoid(t.pl_logit_rows("logit_a").withColumn("logits", F.array(*[F.get("logits", c) - 9 for c in range(6)])), 0.6, 3)


@query("m3_confidence", "SELECT doc, h, t, r, round(1 / (1 + exp(-margin)), 4) AS confidence FROM decoded_a")
def m3(t):
    return decoded(t).select(*PAIR, "r", pp.confidence(F.col("margin")).alias("confidence"))


ASSEMBLED = """
SELECT p.doc, 'E' || p.h AS head_id, ch.name AS head_name, ch.type AS head_type, 'R' || p.class_id AS relation_id,
  translate(lower(trim(coalesce(ri.name, p.r))), ' -/', '___') AS relation_name, 'E' || p.t AS tail_id, ct.name AS tail_name,
  round(1 / (1 + exp(-p.margin)), 4) AS confidence, g.r IS NOT NULL AS is_revised,
  CASE WHEN g.r IS NOT NULL THEN g.ev ELSE coalesce(cast(s.best AS varchar), '') END AS sentence_id
FROM decoded_a p JOIN canon ch ON ch.doc = p.doc AND ch.entity = p.h JOIN canon ct ON ct.doc = p.doc AND ct.entity = p.t
LEFT JOIN rel_info ri ON ri.code = p.r
LEFT JOIN (SELECT doc, h, t, r, coalesce(string_agg(DISTINCT evidence_sent, ',' ORDER BY evidence_sent), '') AS ev FROM oc_labels GROUP BY doc, h, t, r) g
  ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r
LEFT JOIN (SELECT doc, h, t, sent_id AS best FROM pl_sentence_scores
  QUALIFY row_number() OVER (PARTITION BY doc, h, t ORDER BY score DESC, sent_id) = 1) s ON s.doc = p.doc AND s.h = p.h AND s.t = p.t"""


def assembled(t):
    preds = evidence_for_predictions(decoded(t, scores=True), t.oc_label_rows())
    with_texts = with_evidence_text(preds, [*PAIR, "r"], t.oc_sentence_rows())
    return pp.assemble_triples(with_texts, dm.canonical(t.oc_mentions), t.rel_info)


@query("m4_assemble_triples", ASSEMBLED)
def m4(t):
    return assembled(t).select(
        F.col("source.document_id").cast("bigint").alias("doc"), F.col("head.id").alias("head_id"), F.col("head.name").alias("head_name"),
        F.col("head.type").alias("head_type"), F.col("relation.id").alias("relation_id"), F.col("relation.name").alias("relation_name"),
        F.col("tail.id").alias("tail_id"), F.col("tail.name").alias("tail_name"), "confidence", "source.is_revised",
        joined(F.col("source.sentence_id")).alias("sentence_id"))


@query("m5_denoise", """
SELECT l.doc, l.label_no, l.h, l.t, l.r FROM oc_labels l WHERE EXISTS (SELECT 1 FROM decoded_b d WHERE d.doc = l.doc AND d.h = l.h AND d.t = l.t AND d.r = l.r)""")
def m5(t):
    return pp.denoise(t.oc_labels.select("doc", "label_no", "h", "t", "r"), decoded(t, "logit_b")).select("doc", "label_no", "h", "t", "r")


@query("m5_denoised_pairs", """
SELECT l.doc, l.h, l.t, coalesce(array_to_string(list_sort(list(DISTINCT i.class_id) FILTER (d.r IS NOT NULL)), ','), '0') AS class_ids
FROM oc_labels l JOIN rel_ids i ON i.code = l.r LEFT JOIN decoded_b d ON d.doc = l.doc AND d.h = l.h AND d.t = l.t AND d.r = l.r
GROUP BY l.doc, l.h, l.t""")
def m5_pairs(t):
    out = pp.denoised_pairs(t.oc_labels.select("doc", "h", "t", "r"), decoded(t, "logit_b"), t.rel_ids)
    return out.select("doc", "h", "t", F.array_join("class_ids", ",").alias("class_ids"))


@query("m5_denoise_counts", """
SELECT count(d.r) AS n_kept, count(*) - count(d.r) AS n_dropped
FROM oc_labels l LEFT JOIN decoded_b d ON d.doc = l.doc AND d.h = l.h AND d.t = l.t AND d.r = l.r""")
def m5_counts(t):
    return pp.denoise_counts(t.oc_labels.select("doc", "h", "t", "r"), decoded(t, "logit_b"))


CONF = "round(1 / (1 + exp(-margin)), 4)"


@query("m6_confidence_bands", f"""
SELECT CASE WHEN {CONF} >= 0.95 THEN 'high' WHEN {CONF} >= 0.8 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM decoded_a GROUP BY band""")
def m6(t):
    banded = decoded(t).select(pp.confidence_band(pp.confidence(F.col("margin")), HIGH_CONFIDENCE, LOW_CONFIDENCE).alias("band"))
    return banded.groupBy("band").agg(F.count("*").alias("n"))


TKEY = "doc || '#' || h || '#' || t || '#' || r"


@query("m7_band_verdicts", f"""
SELECT key, confidence, band, CASE band WHEN 'high' THEN 'pass' ELSE 'accept' END AS action, CASE band WHEN 'mid' THEN 'reason ' || key END AS reason
FROM (SELECT {TKEY} AS key, {CONF} AS confidence, CASE WHEN {CONF} >= 0.95 THEN 'high' WHEN {CONF} >= 0.8 THEN 'mid' ELSE 'low' END AS band FROM decoded_a)
WHERE band = 'high' OR (band = 'mid' AND ascii(substr(md5(key), 1, 1)) % 3 <> 0)""")
def m7(t):
    triples = decoded(t).select(F.concat_ws("#", *PAIR, "r").alias("key"), pp.confidence(F.col("margin")).alias("confidence"))
    verdicts = triples.select("key", (F.ascii(F.substring(F.md5("key"), 1, 1)) % 3 != 0).alias("accept"),
                              F.concat(F.lit("reason "), "key").alias("reason"))
    return pp.apply_band_verdicts(triples, verdicts, "key", HIGH_CONFIDENCE, LOW_CONFIDENCE)


# the sub-documents keep the sentences with a large order quantity; the second run scored them
SUB = """SELECT doc, entity, (dense_rank() OVER (PARTITION BY doc ORDER BY entity) - 1)::INT AS new_entity
  FROM (SELECT DISTINCT m.doc, m.entity FROM oc_mentions m JOIN oc_items i ON i.doc = m.doc AND i.sent_id = m.sent_id WHERE i.l_quantity > 15)"""
FUSED = f"""SELECT l.doc, l.h, l.t, l.class_id, l.logit_a, CASE WHEN a.doc IS NOT NULL AND b.doc IS NOT NULL THEN l.logit_b END AS sub FROM pl_logits l
  LEFT JOIN ({SUB}) a ON a.doc = l.doc AND a.entity = l.h LEFT JOIN ({SUB}) b ON b.doc = l.doc AND b.entity = l.t"""


def sub_logits(t):
    """The second run's logits under the sub-documents' own entity ids, and the id map."""
    keep = t.oc_items.filter("l_quantity > 15").select("doc", "sent_id")
    ids = dm.sub_document(keep, t.oc_mentions)[1].withColumn("new_entity", F.col("new_entity").cast("int"))
    sub = dm.renumbered(t.pl_logit_rows("logit_b"), ids, "entity", "new_entity")
    return sub, ids


@query("m8_fuse_logits", f"SELECT doc, h, t, class_id, round(CASE WHEN sub IS NULL THEN logit_a ELSE logit_a + sub - 0.5 END, 9) AS logit FROM ({FUSED})")
def m8(t):
    sub, ids = sub_logits(t)
    fused = pp.fuse_logits(t.pl_logit_rows("logit_a"), sub, 0.5, ids)
    return rounded(fused.select(*PAIR, F.posexplode("logits").alias("class_id", "logit")), "logit")


def prf_sql(correct, pred, gold):
    p, r = f"coalesce({correct} / nullif({pred}, 0), 0)", f"coalesce({correct} / nullif({gold}, 0), 0)"
    return f"round({p}, 9) AS precision, round({r}, 9) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 9) AS f1"


@query("m9_gamma_sweep", f"""
WITH f AS ({FUSED}), z AS (SELECT *, max(CASE WHEN class_id = 0 THEN logit_a END) OVER w AS th_a, max(CASE WHEN class_id = 0 THEN sub END) OVER w AS th_sub
  FROM f WINDOW w AS (PARTITION BY doc, h, t)),
grid AS (SELECT unnest([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0])::DOUBLE AS value),
p AS (SELECT value, z.doc, z.h, z.t, c.code AS r FROM z CROSS JOIN grid JOIN rel_ids c ON c.class_id = z.class_id WHERE z.class_id > 0
  AND CASE WHEN sub IS NULL THEN logit_a > th_a ELSE logit_a + sub > th_a + th_sub END),
k AS (SELECT value, count(*) AS n_pred, count(g.r) AS n_correct FROM p LEFT JOIN gold g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r GROUP BY value)
SELECT grid.value, coalesce(n_pred, 0) AS n_pred, coalesce(n_correct, 0) AS n_correct, (SELECT count(*) FROM gold) AS n_gold,
  {prf_sql("coalesce(n_correct, 0)", "coalesce(n_pred, 0)", "(SELECT count(*) FROM gold)")} FROM grid LEFT JOIN k ON k.value = grid.value""")
def m9(t):
    """gamma shifts the class and its threshold alike inside one pair, so the margin decides once; the sweep shows it."""
    sub, ids = sub_logits(t)
    fused = pp.fuse_logits(t.pl_logit_rows("logit_a"), sub, 0.0, ids)
    margin = pp.with_threshold(fused).filter("class_id > 0").join(t.rel_ids.withColumnRenamed("code", "r"), "class_id")
    scored = margin.select(*PAIR, "r", (F.col("logit") > F.col("th")).alias("beats"))
    return rounded(pp.sweep(scored, t.oc_labels, GAMMA_GRID, lambda gamma: F.col("beats")).drop("pos"), "precision", "recall", "f1")


THRESHOLDS = f"""
WITH grid AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS value),
p AS (SELECT value, l.doc, l.h, l.t, c.code AS r FROM pl_logits l CROSS JOIN grid JOIN rel_ids c ON c.class_id = l.class_id
  WHERE l.class_id > 0 AND 1 / (1 + exp(-(logit_a - 13))) > value),
k AS (SELECT value, count(*) AS n_pred, count(g.r) AS n_correct FROM p LEFT JOIN gold g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r GROUP BY value)
SELECT value, n_pred, n_correct, (SELECT count(*) FROM gold) AS n_gold, {prf_sql("n_correct", "n_pred", "(SELECT count(*) FROM gold)")} FROM k"""


def threshold_sweep(t):
    rows = logits(t).filter("class_id > 0").join(t.rel_ids.withColumnRenamed("code", "r"), "class_id")
    scored = rows.select(*PAIR, "r", pp.sigmoid(F.col("logit") - 13).alias("p"))
    return pp.sweep(scored, t.oc_labels, THRESHOLD_GRID, lambda value: F.col("p") > value)


@query("m9_threshold_sweep", THRESHOLDS)
def m9_threshold(t):
    return rounded(threshold_sweep(t).drop("pos"), "precision", "recall", "f1")


@query("m9_best_threshold", f"SELECT value, precision, recall, f1 FROM ({THRESHOLDS}) ORDER BY f1 DESC, value LIMIT 1")
def m9_best(t):
    return rounded(pp.best_of(threshold_sweep(t)), "precision", "recall", "f1")


ALL_MARGINS = """SELECT l.doc, l.h, l.t, l.class_id, l.logit_a - th AS margin FROM pl_logits l JOIN (SELECT doc, h, t, logit_a AS th FROM pl_logits WHERE class_id = 0) z
  ON z.doc = l.doc AND z.h = l.h AND z.t = l.t WHERE l.class_id > 0"""


def margins(t):
    return pp.with_threshold(t.pl_logit_rows("logit_a")).filter("class_id > 0").select(*PAIR, "class_id", (F.col("logit") - F.col("th")).alias("margin"))


@query("m10_uncertain", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY abs(margin), h, t, class_id) - 1 AS rank FROM ({ALL_MARGINS}) WHERE abs(margin) < 0.5),
p AS (SELECT doc, rank // 20 AS pack, count(*) AS n_rows, min(abs(margin)) AS closest, count(*) FILTER (margin > 0) AS above,
  string_agg(h || '>' || t || ':' || class_id, ' ' ORDER BY rank) AS triples FROM n GROUP BY doc, rank // 20)
SELECT doc, pack, n_rows, round(closest, 9) AS closest, above, triples, row_number() OVER (ORDER BY closest, doc, pack) <= 1000 AS asked FROM p""")
def m10(t):
    rows = pp.uncertain_packs(margins(t), 0.5, 1000)
    triple = F.concat(F.col("h").cast("string"), F.lit(">"), F.col("t").cast("string"), F.lit(":"), F.col("class_id").cast("string"))
    packs = rows.groupBy("doc", "pack", "asked").agg(
        F.count("*").alias("n_rows"), F.round(F.min(F.abs("margin")), 9).alias("closest"), F.count_if(F.col("side") == "above").alias("above"),
        F.array_join(F.array_sort(F.collect_list(F.struct("place", triple.alias("triple")))).getField("triple"), " ").alias("triples"))  # at most a pack
    return packs


@query("m11_type_constraints", """
SELECT p.doc, p.h, p.t, p.r, CASE p.r WHEN 'P17' THEN c.type = 'LOC' WHEN 'P176' THEN c.type = 'ORG' WHEN 'P361' THEN c.type IN ('MISC', 'LOC') ELSE true END AS allowed
FROM decoded_a p JOIN canon c ON c.doc = p.doc AND c.entity = p.t""")
def m11(t):
    rules = t.rel_info.filter("code IN ('P17', 'P176', 'P361')").select(F.col("code").alias("r"), F.explode(
        F.when(F.col("code") == "P17", F.array(F.lit("LOC"))).when(F.col("code") == "P176", F.array(F.lit("ORG")))
        .otherwise(F.array(F.lit("MISC"), F.lit("LOC")))).alias("tail_type"))
    tails = dm.canonical(t.oc_mentions).select("doc", F.col("entity").alias("t"), F.col("type").alias("tail_type"))
    return pp.type_constraints(decoded(t).join(tails, ["doc", "t"]), rules).select(*PAIR, "r", "allowed")


NAMED_PRED = """SELECT p.doc, p.h, p.t, p.r, p.margin, a.name AS head_name, b.name AS tail_name FROM decoded_a p
  JOIN canon a ON a.doc = p.doc AND a.entity = p.h JOIN canon b ON b.doc = p.doc AND b.entity = p.t"""


@query("m12_reuse_known", f"""
WITH n AS ({NAMED_PRED}) SELECT doc, h, t, r FROM n WHERE margin < 1 AND EXISTS (SELECT 1 FROM n k WHERE k.margin >= 3
  AND k.head_name = n.head_name AND k.r = n.r AND k.tail_name = n.tail_name)""")
def m12(t):
    canon = dm.canonical(t.oc_mentions)
    named = (decoded(t).join(canon.select("doc", F.col("entity").alias("h"), F.col("name").alias("head_name")), ["doc", "h"])
             .join(canon.select("doc", F.col("entity").alias("t"), F.col("name").alias("tail_name")), ["doc", "t"]))
    return pp.reuse_known(named.filter("margin < 1"), named.filter("margin >= 3")).select(*PAIR, "r")


@query("m13_transition", """
SELECT CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL THEN 'both' WHEN b.r IS NOT NULL THEN 'rescued' WHEN a.r IS NOT NULL THEN 'lost' ELSE 'neither' END AS outcome,
  count(*) AS n FROM gold g LEFT JOIN decoded_a a ON a.doc = g.doc AND a.h = g.h AND a.t = g.t AND a.r = g.r
LEFT JOIN decoded_b b ON b.doc = g.doc AND b.h = g.h AND b.t = g.t AND b.r = g.r GROUP BY outcome""")
def m13(t):
    return pp.transition(decoded(t), decoded(t, "logit_b"), t.oc_labels)


@query("m13_net_gain", """
SELECT count(*) FILTER (a.r IS NULL AND b.r IS NOT NULL) AS rescued, count(*) FILTER (a.r IS NOT NULL AND b.r IS NULL) AS lost,
  count(*) FILTER (a.r IS NULL AND b.r IS NOT NULL) - count(*) FILTER (a.r IS NOT NULL AND b.r IS NULL) AS net_gain
FROM gold g LEFT JOIN decoded_a a ON a.doc = g.doc AND a.h = g.h AND a.t = g.t AND a.r = g.r
LEFT JOIN decoded_b b ON b.doc = g.doc AND b.h = g.h AND b.t = g.t AND b.r = g.r""")
def m13_net(t):
    return pp.net_gain(pp.transition(decoded(t), decoded(t, "logit_b"), t.oc_labels))


# --- scoring -----------------------------------------------------------------------------------------------------
# predictions of one unknown document per customer stay in the precision denominator
PREDS = "SELECT doc, h, t, r FROM decoded_a UNION ALL SELECT -1 - c_custkey, 0, 1, 'P17' FROM customer"
JUDGED = f"""SELECT coalesce(p.doc, g.doc) AS doc, coalesce(p.h, g.h) AS h, coalesce(p.t, g.t) AS t, coalesce(p.r, g.r) AS r, p.r IS NOT NULL AS pred, g.r IS NOT NULL AS gold
  FROM ({PREDS}) p FULL JOIN gold g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r"""
COUNTS = "count(*) FILTER (pred) AS n_pred, count(*) FILTER (gold) AS n_gold, count(*) FILTER (pred AND gold) AS n_correct"
PRF = prf_sql("n_correct", "n_pred", "n_gold")


def predictions(t):
    unknown = t.customer.select((-1 - F.col("c_custkey")).alias("doc"), F.lit(0).alias("h"), F.lit(1).alias("t"), F.lit("P17").alias("r"))
    return decoded(t).select(*PAIR, "r").unionByName(unknown)


@query("v1_score", f"SELECT *, {PRF} FROM (SELECT {COUNTS} FROM ({JUDGED}))")
def v1(t):
    return rounded(ev.score(predictions(t), t.oc_labels), "precision", "recall", "f1")


def facts(t, split):
    rows = t.oc_splits.filter(F.col("split") == split).select("doc")
    return ev.train_facts(t.oc_labels.join(rows, "doc", "left_semi"), t.oc_mentions)


@query("v2_train_facts", "SELECT head_name, tail_name, r FROM facts_of WHERE split = 'train_annotated'")
def v2(t):
    return facts(t, "train_annotated")


KNOWN = """SELECT DISTINCT j.doc, j.h, j.t, j.r FROM ({rows}) j JOIN oc_mentions a ON a.doc = j.doc AND a.entity = j.h
  JOIN oc_mentions b ON b.doc = j.doc AND b.entity = j.t JOIN (SELECT * FROM facts_of WHERE split = '{split}') f
  ON f.head_name = a.name AND f.tail_name = b.name AND f.r = j.r"""
DEV = "doc IN (SELECT doc FROM oc_splits WHERE split = 'dev_revised')"
DEV_JUDGED = f"SELECT * FROM ({JUDGED}) WHERE {DEV} OR doc < 0"
CORRECT = f"SELECT * FROM ({DEV_JUDGED}) WHERE pred AND gold"


def dev_rows(t, df):
    return df.join(t.oc_splits.filter("split = 'dev_revised'").select("doc"), "doc", "left_semi")


def dev_predictions(t):
    return dev_rows(t, predictions(t)).unionByName(predictions(t).filter("doc < 0"))


@query("v3_score_ign", f"""
SELECT *, {PRF}, round(ip, 9) AS ign_precision, round(coalesce(2 * ip * (n_correct / n_gold) / nullif(ip + n_correct / n_gold, 0), 0), 9) AS ign_f1 FROM (
  SELECT *, coalesce((n_correct - n_known) / nullif(n_pred - n_known, 0), 0) AS ip FROM (
    SELECT {COUNTS}, (SELECT count(*) FROM ({KNOWN.format(rows=CORRECT, split='train_annotated')})) AS n_known FROM ({DEV_JUDGED})))""")
def v3(t):
    out = ev.score_ign(dev_predictions(t), dev_rows(t, t.oc_labels), t.oc_mentions, facts(t, "train_annotated"))
    out = out.withColumn("ip", F.col("ign_precision"))
    return rounded(out, "precision", "recall", "f1", "ign_precision", "ign_f1")


OFFICIAL = f"""
WITH g AS (SELECT doc, h, t, r, arg_max(coalesce(evidence_sent, -1), label_no) AS ge, count(evidence_sent) AS n_ev FROM oc_labels WHERE {DEV} GROUP BY doc, h, t, r),
p AS (SELECT *, CASE WHEN h % 3 = 0 THEN NULL ELSE (h + t) % 3 END AS pe FROM ({PREDS}) WHERE {DEV} OR doc < 0),
j AS (SELECT coalesce(p.doc, g.doc) AS doc, coalesce(p.h, g.h) AS h, coalesce(p.t, g.t) AS t, coalesce(p.r, g.r) AS r, p.r IS NOT NULL AS pred, g.r IS NOT NULL AS gold, pe, ge, n_ev
  FROM p FULL JOIN g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t AND g.r = p.r),
c AS (SELECT {COUNTS}, count(pe) FILTER (pred AND doc >= 0) AS pred_evidence, sum(n_ev)::BIGINT AS gold_evidence_total,
  count(*) FILTER (pred AND gold AND pe = ge) AS hit_evidence,
  (SELECT count(*) FROM ({KNOWN.format(rows='SELECT * FROM j WHERE pred AND gold', split='train_annotated')})) AS n_a,
  (SELECT count(*) FROM ({KNOWN.format(rows='SELECT * FROM j WHERE pred AND gold', split='test_revised')})) AS n_d FROM j)
SELECT *, {PRF}, round(coalesce(2 * (hit_evidence / pred_evidence) * (hit_evidence / gold_evidence_total) / nullif(hit_evidence / pred_evidence + hit_evidence / gold_evidence_total, 0), 0), 9) AS evidence_f1,
  round(coalesce(2 * ((n_correct - n_a) / (n_pred - n_a)) * (n_correct / n_gold) / nullif((n_correct - n_a) / (n_pred - n_a) + n_correct / n_gold, 0), 0), 9) AS ign_annotated_f1,
  round(coalesce(2 * ((n_correct - n_d) / (n_pred - n_d)) * (n_correct / n_gold) / nullif((n_correct - n_d) / (n_pred - n_d) + n_correct / n_gold, 0), 0), 9) AS ign_distant_f1 FROM c"""


@query("v4_score_official", OFFICIAL)
def v4(t):
    # every prediction is submitted twice; the repetition carries other evidence and must lose
    first = dev_predictions(t).withColumn("evidence", F.when(F.col("h") % 3 == 0, dm.empty_ints()).otherwise(
        F.array(((F.col("h") + F.col("t")) % 3).cast("int")))).withColumn("pos", F.lit(0))
    again = first.withColumn("evidence", F.array(F.lit(7), F.lit(8))).withColumn("pos", F.lit(1))
    out = ev.score_official(first.unionByName(again), dev_rows(t, t.oc_label_rows()), t.oc_items.select("doc"), t.oc_mentions,
                            facts(t, "train_annotated"), facts(t, "test_revised"))
    return rounded(out, "precision", "recall", "f1", "evidence_f1", "ign_annotated_f1", "ign_distant_f1")


@query("v5_score_per_relation", f"SELECT *, {PRF} FROM (SELECT r, {COUNTS} FROM ({JUDGED}) GROUP BY r)")
def v5(t):
    return rounded(ev.score_per_relation(predictions(t), t.oc_labels), "precision", "recall", "f1")


@query("v6_score_by_locality", f"""
SELECT *, {PRF} FROM (SELECT CASE WHEN len(list_intersect(a.sents, b.sents)) > 0 THEN 'intra' ELSE 'inter' END AS locality, {COUNTS} FROM ({JUDGED}) j
  JOIN ent_sents a ON a.doc = j.doc AND a.entity = j.h JOIN ent_sents b ON b.doc = j.doc AND b.entity = j.t GROUP BY locality)""")
def v6(t):
    return rounded(ev.score_by_locality(predictions(t), t.oc_labels, t.oc_mentions), "precision", "recall", "f1")


@query("v7_score_by_frequency", f"""
WITH c AS (SELECT r, count(*) AS n FROM oc_labels GROUP BY r)
SELECT *, {PRF} FROM (SELECT CASE WHEN n >= 0.1 * (SELECT sum(n) FROM c) THEN 'frequent' ELSE 'long_tail' END AS band, {COUNTS}
  FROM ({JUDGED}) j LEFT JOIN c ON c.r = j.r GROUP BY band)""")
def v7(t):
    counts = t.oc_labels.groupBy("r").agg(F.count("*").alias("n"))
    return rounded(ev.score_by_frequency(predictions(t), t.oc_labels, counts, 0.1), "precision", "recall", "f1")


@query("v8_distant_audit", f"""
WITH lab AS (SELECT DISTINCT p.doc, p.h, p.t, f.r FROM (SELECT * FROM pl_pairs WHERE {DEV}) p JOIN oc_mentions a ON a.doc = p.doc AND a.entity = p.h
  JOIN oc_mentions b ON b.doc = p.doc AND b.entity = p.t JOIN (SELECT * FROM facts_of WHERE split = 'train_annotated') f ON f.head_name = a.name AND f.tail_name = b.name)
SELECT CASE WHEN l.r IS NOT NULL AND g.r IS NOT NULL THEN 'caught' WHEN g.r IS NOT NULL THEN 'missed' ELSE 'false_positive' END AS outcome, count(*) AS n
FROM lab l FULL JOIN (SELECT * FROM gold WHERE {DEV}) g ON g.doc = l.doc AND g.h = l.h AND g.t = l.t AND g.r = l.r GROUP BY outcome""")
def v8(t):
    return ev.distant_audit(dev_rows(t, t.pl_pairs), dev_rows(t, t.oc_mentions), facts(t, "train_annotated"), dev_rows(t, t.oc_labels))


@query("v9_leakage", f"""
WITH k AS ({KNOWN.format(rows=f'SELECT * FROM gold WHERE {DEV}', split='train_annotated')}), n AS (SELECT count(*) AS n_gold FROM gold WHERE {DEV}),
ti AS (SELECT s.split, o_custkey AS title FROM oc_splits s JOIN orders ON o_orderkey = s.doc)
SELECT n_gold, (SELECT count(*) FROM k) AS n_seen, round((SELECT count(*) FROM k) / n_gold, 9) AS seen_share,
  (SELECT count(*) FROM (SELECT title FROM ti WHERE split = 'train_annotated' INTERSECT SELECT title FROM ti WHERE split = 'dev_revised')) AS shared_titles FROM n""")
def v9(t):
    titles = t.oc_splits.join(t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("title")), "doc")
    of = lambda s: titles.filter(F.col("split") == s)
    out = ev.leakage(of("train_annotated"), of("dev_revised"), dev_rows(t, t.oc_labels), t.oc_mentions, facts(t, "train_annotated"))
    return rounded(out, "seen_share")


GOLD_FACTS = """SELECT c_custkey AS question_id, 1 AS gold_idx, upper(c_name) AS head, 'COUNTRY' AS relation, lower('NATION_' || c_nationkey) AS tail, cast(NULL AS string) AS evidence FROM customer
  UNION ALL SELECT c_custkey, 0, 'x', 'PART_OF', 'y', 'NATION_' || cast(c_nationkey AS string) || ' lies in AFRICA' FROM customer"""
RETRIEVED = "SELECT question_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY head, relation, tail) - 1 AS int) AS pos, head, relation, tail, evidence FROM tg_facts"


@query("v10_match_facts", f"""
SELECT f.question_id, f.pos, min(g.gold_idx) AS gold_idx FROM ({RETRIEVED}) f LEFT JOIN ({GOLD_FACTS}) g ON g.question_id = f.question_id
  AND ((lower(g.head) = lower(f.head) AND g.relation = f.relation AND lower(g.tail) = lower(f.tail)) OR (f.evidence <> '' AND g.evidence = f.evidence)) GROUP BY f.question_id, f.pos""")
def v10(t):
    return ev.match_facts(t.sql(RETRIEVED), t.sql(GOLD_FACTS)).select("question_id", "pos", "gold_idx")


NORM = "lower(trim(regexp_replace(regexp_replace({c}, '\\s+([,.''\\)\\]:;!?%])', '\\1', 'g'), '\\s+', ' ', 'g')))"


# question = document; chunks = its lines; gold = a part of its first line and its whole last line, tokenised
@query("v11_match_chunks", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS z FROM tx_sentences),
g AS (SELECT doc_id, 0 AS idx, {NORM.format(c="substr(replace(sentence, ',', ' ,'), 1, 30)")} AS ge FROM l WHERE a = 1
  UNION ALL SELECT doc_id, 1, {NORM.format(c="replace(sentence, '.', ' .') || ' The end .'")} FROM l WHERE z = 1)
SELECT l.doc_id AS question_id, l.pos, min(g.idx) AS gold_idx FROM l LEFT JOIN g ON g.doc_id = l.doc_id
  AND (contains(ge, {NORM.format(c='sentence')}) OR contains({NORM.format(c='sentence')}, ge)) GROUP BY l.doc_id, l.pos""")
def v11(t):
    chunks = text_sentences(t).select(F.col("doc_id").alias("question_id"), F.col("pos").cast("bigint").alias("pos"), F.col("sentence").alias("text"))
    ends = chunks.groupBy("question_id").agg(F.min_by("text", "pos").alias("a"), F.max_by("text", "pos").alias("z"))
    head = F.substring(F.replace("a", F.lit(","), F.lit(" ,")), 1, 30)
    tail = F.concat(F.replace("z", F.lit("."), F.lit(" .")), F.lit(" The end ."))
    gold = ends.select("question_id", F.inline(F.array(
        F.struct(F.lit(0).alias("gold_idx"), F.lit(None).cast("string").alias("evidence")), F.struct(F.lit(1).alias("gold_idx"), head.alias("evidence")),
        F.struct(F.lit(2).alias("gold_idx"), tail.alias("evidence")))))
    return ev.match_chunks(chunks, gold).select("question_id", "pos", F.col("gold_idx").cast("int").alias("gold_idx"))


# relevant = same label; three gold groups per label, so that hits repeat
NEIGHBOURS = f"""SELECT a.vec_id AS question_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS.format(a='a', b='b')} DESC, b.vec_id) - 1 AS pos,
  CASE WHEN a.label = b.label THEN b.vec_id % 3 END AS gold_idx, a.label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY pos < 10"""
METRICS = f"""
WITH m AS ({NEIGHBOURS}), f AS (SELECT *, CASE WHEN gold_idx IS NOT NULL AND pos = min(pos) OVER (PARTITION BY question_id, gold_idx) THEN 1 ELSE 0 END AS first FROM m),
x AS (SELECT *, sum(first) OVER (PARTITION BY question_id ORDER BY pos) AS hits FROM f),
k AS (SELECT question_id, any_value(label) AS label, count(gold_idx) / count(*) AS p, sum(first) / 3 AS r, sum(first / log2(pos + 2)) / (1 + 1 / log2(3) + 1 / log2(4)) AS ndcg,
  sum(CASE WHEN first = 1 THEN hits / (pos + 1) ELSE 0 END) / 3 AS ap FROM x GROUP BY question_id)
SELECT question_id, label, round(p, 9) AS precision, round(r, 9) AS recall, round(ndcg, 9) AS ndcg, round(ap, 9) AS ap, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM k"""


def metric_rows(t):
    from factloom.functions.vectors import cosine_topk
    near = cosine_topk(vectors(t).withColumnRenamed("vec_id", "query_id"), vectors(t), 10)
    labels = t.embeddings.select("vec_id", "label")
    both = near.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "own"}), "query_id").join(labels, "vec_id")
    matched = both.select(F.col("query_id").alias("question_id"), (F.col("rank") - 1).alias("pos"),
                          F.when(F.col("own") == F.col("label"), F.col("vec_id") % 3).alias("gold_idx"))
    return ev.retrieval_metrics(matched, labels.select(F.col("vec_id").alias("question_id"), F.lit(3).alias("n_gold")))


@query("v12_retrieval_metrics", f"SELECT question_id, precision, recall, ndcg, ap, f1 FROM ({METRICS})")
def v12(t):
    return rounded(metric_rows(t), "precision", "recall", "ndcg", "ap", "f1")


@query("v13_macro_average", f"""
SELECT 'label ' || label AS system, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ap), 6) AS ap FROM ({METRICS}) GROUP BY label""")
def v13(t):
    labels = t.embeddings.select(F.col("vec_id").alias("question_id"), F.concat(F.lit("label "), "label").alias("system"))
    out = ev.macro_average(metric_rows(t).join(labels, "question_id"), ["precision", "recall", "ap"])
    return out.select("system", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap")])


@query("v14_resolve_gold", """
SELECT q.question_id, q.head, q.relation, q.tail, e.evidence FROM (
  SELECT c_custkey AS question_id, 'NATION_' || c_nationkey AS head, 'COUNTRY' AS relation, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'nobody' END AS tail FROM customer) q
LEFT JOIN (SELECT h.name AS a, relation_type, x.name AS b, min(evidence) AS evidence FROM tg_edges JOIN tg_entities h ON h.id = head_id JOIN tg_entities x ON x.id = tail_id GROUP BY ALL) e
  ON e.relation_type = q.relation AND e.b = q.head AND e.a = q.tail""")
def v14(t):
    gold = t.customer.select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("NATION_"), "c_nationkey").alias("head"),
                             F.lit("COUNTRY").alias("relation"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("nobody").alias("tail"))
    return ev.resolve_gold(gold, g.ends_joined(t.tg_edges, t.tg_entities)).select("question_id", "head", "relation", "tail", "evidence")


@query("v15_select_run", """
WITH h AS (SELECT *, coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prior FROM ev_history),
i AS (SELECT *, max(CASE WHEN f1 > prior THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_up FROM h),
s AS (SELECT run, min(CASE WHEN epoch - last_up >= 3 THEN epoch END) AS early, max(epoch) AS last FROM i GROUP BY run)
SELECT s.run, coalesce(early, last) AS stop_epoch, early IS NOT NULL AS stopped_early, arg_max(epoch, f1 * 1e6 - epoch) AS best_epoch, round(max(f1), 9) AS best_f1
FROM s JOIN h ON h.run = s.run AND h.epoch <= coalesce(early, last) GROUP BY s.run, early, last""")
def v15(t):
    return rounded(ev.select_run(t.ev_history, 3), "best_f1")


SYSTEMS = f"""SELECT 'run a' AS system, n_correct, n_pred, n_gold FROM (SELECT {COUNTS} FROM ({JUDGED}))
UNION ALL SELECT 'run b', (SELECT count(*) FROM decoded_b JOIN gold USING (doc, h, t, r)), (SELECT count(*) FROM decoded_b), (SELECT count(*) FROM gold)"""


@query("v16_compare_runs", f"""
WITH s AS (SELECT system, {PRF} FROM ({SYSTEMS})) SELECT s.*, round(s.f1 - b.f1, 6) AS delta_f1, s.f1 >= 0.9 * b.f1 AS accepted FROM s JOIN s b ON b.system = 'run a'""")
def v16(t):
    rows = ev.score(predictions(t), t.oc_labels).withColumn("system", F.lit("run a")).unionByName(
        ev.score(decoded(t, "logit_b"), t.oc_labels).withColumn("system", F.lit("run b")))
    out = ev.compare_runs(rows.select("system", "precision", "recall", "f1"), "run a", ["f1"])
    out = out.withColumn("accepted", ev.accepted("f1", F.col("f1") - F.col("delta_f1")))
    return rounded(out, "precision", "recall", "f1").withColumn("delta_f1", F.round("delta_f1", 6))


@query("v17_prediction_diff", """
SELECT a.r IS NOT NULL AS in_a, b.r IS NOT NULL AS in_b, g.r IS NOT NULL AS correct, count(*) AS n FROM decoded_a a FULL JOIN decoded_b b
  ON b.doc = a.doc AND b.h = a.h AND b.t = a.t AND b.r = a.r LEFT JOIN gold g ON g.doc = coalesce(a.doc, b.doc) AND g.h = coalesce(a.h, b.h)
  AND g.t = coalesce(a.t, b.t) AND g.r = coalesce(a.r, b.r) GROUP BY ALL""")
def v17(t):
    return ev.prediction_diff(decoded(t), decoded(t, "logit_b"), t.oc_labels)


# --- profiling ---------------------------------------------------------------------------------------------------
DOC_STATS = """SELECT s.doc, sp.split, s.n_sents, s.n_tokens, m.n_entities, m.n_mentions, coalesce(l.n, 0) AS n_labels FROM
  (SELECT doc, count(*) AS n_sents, sum(n_tokens)::BIGINT AS n_tokens FROM oc_sentences GROUP BY doc) s
  JOIN (SELECT doc, count(DISTINCT entity) AS n_entities, count(*) AS n_mentions FROM oc_mentions GROUP BY doc) m USING (doc)
  JOIN oc_splits sp USING (doc) LEFT JOIN (SELECT doc, count(*) AS n FROM oc_labels GROUP BY doc) l USING (doc)"""


def stats(t):
    return pf.doc_stats(t.docs().join(t.oc_splits, "doc"))


@query("a1_doc_stats", DOC_STATS)
def a1(t):
    return stats(t).select("doc", "split", *[F.col(c).cast("bigint").alias(c) for c in pf.STATS])


@query("a2_split_summary", "SELECT split, count(*) AS n_docs, " + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in pf.STATS) + f" FROM ({DOC_STATS}) GROUP BY split")
def a2(t):
    out = pf.split_summary(stats(t))
    return out.select("split", "n_docs", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("a3_entity_type_counts", "SELECT type, count(*) AS n FROM oc_mentions GROUP BY type")
def a3(t):
    return pf.entity_type_counts(t.oc_mentions)


@query("a4_relation_counts", "SELECT r, count(*) AS n, any_value(name) AS relation_name FROM oc_labels JOIN rel_info ON code = r GROUP BY r")
def a4(t):
    return pf.relation_counts(t.oc_labels, t.rel_info, 20).select("r", "n", "relation_name")


@query("a5_locality_counts", """
SELECT intra, inter, round(intra / (intra + inter), 9) AS intra_share FROM (SELECT count(*) FILTER (len(list_intersect(a.sents, b.sents)) > 0) AS intra,
  count(*) FILTER (len(list_intersect(a.sents, b.sents)) = 0) AS inter FROM oc_labels l
  JOIN ent_sents a ON a.doc = l.doc AND a.entity = l.h JOIN ent_sents b ON b.doc = l.doc AND b.entity = l.t)""")
def a5(t):
    return rounded(pf.locality_counts(t.oc_label_rows(), t.oc_mentions), "intra_share")


@query("a6_evidence_length", """
SELECT round(avg((evidence_sent IS NOT NULL)::INT), 9) AS mean, median((evidence_sent IS NOT NULL)::INT)::DOUBLE AS median, max((evidence_sent IS NOT NULL)::INT) AS longest FROM oc_labels""")
def a6(t):
    return rounded(pf.evidence_length_stats(t.oc_label_rows()), "mean")


@query("a7_histogram", """
SELECT least(floor((n_chars - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM documents
CROSS JOIN (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) GROUP BY bin""")
def a7(t):
    return pf.histogram(t.documents, "n_chars", 30)


@query("a8_na_ratio", """
SELECT count(*) AS n_pairs, round(avg((g.doc IS NULL)::INT), 9) AS na_share FROM (SELECT a.doc, a.entity AS h, b.entity AS t FROM oc_entities a JOIN oc_entities b ON a.doc = b.doc AND a.entity <> b.entity) p
LEFT JOIN (SELECT DISTINCT doc, h, t FROM gold) g ON g.doc = p.doc AND g.h = p.h AND g.t = p.t""")
def a8(t):
    return rounded(pf.na_ratio(dm.candidate_facts(t.oc_mentions, t.oc_labels.select(*PAIR).distinct()), t.oc_labels), "na_share")


@query("a9_overlong_share", f"SELECT count(*) AS n_docs, round(avg((len({DUCK_TOKENS}) > 512)::INT), 9) AS overlong_share FROM documents")
def a9(t):
    return rounded(pf.overlong_share(text_tokens(t).select(F.size("tokens").alias("n_tokens")), 512), "overlong_share")


@query("a10_split_counts", "SELECT split, count(*) AS n_docs FROM oc_splits GROUP BY split")
def a10(t):
    return pf.split_counts(t.oc_splits)


# --- streaming ---------------------------------------------------------------------------------------------------
# edges arrive in two files: all edges, then the customers' and suppliers' edges again with a new confidence
@query("t1_stream_upsert", """
SELECT head_id, relation_type, tail_id, document, CASE WHEN relation_type = 'COUNTRY' THEN 0.75e0 ELSE confidence END AS confidence FROM tg_edges""")
def t1(t):
    from uuid import uuid4

    from factloom.session import ensure_checkpoint_dir
    from factloom.streaming.upsert import read_stream, read_upserted, stream_upsert
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"
    rows = t.tg_edges.select(*g.EDGE_KEY, "confidence").withColumn("seq", F.xxhash64(*g.EDGE_KEY))
    rows.write.mode("append").parquet(f"{root}/in")
    run = lambda: stream_upsert(read_stream(t.spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/offsets").awaitTermination()
    run()
    rows.filter("relation_type = 'COUNTRY'").withColumn("confidence", F.lit(0.75)).write.mode("append").parquet(f"{root}/in")
    run()
    return read_upserted(t.spark, f"{root}/out").select(*g.EDGE_KEY, "confidence")


# sightings of entities arrive in two files, later documents first; an entity is a name here, and its type that of its last document
@query("t1_stream_entities", """
WITH s AS (SELECT c.name, c.type, m.name AS alias, c.doc * 1000 + c.entity AS seq FROM canon c JOIN oc_mentions m ON m.doc = c.doc AND m.entity = c.entity)
SELECT name AS id, arg_max(type, seq) AS type, arg_min(type, seq) AS first_type, string_agg(DISTINCT alias, ' | ' ORDER BY alias) AS aliases,
  min(seq)::BIGINT AS first_seq, max(seq)::BIGINT AS last_seq FROM s GROUP BY name""")
def t1_entities(t):
    from pyspark.sql.types import _parse_datatype_string

    from factloom.session import shared_folder
    from factloom.streaming import entities as en
    from factloom.streaming.upsert import read_stream
    root = shared_folder(t.spark, "entity-stream")
    names = dm.canonical(t.oc_mentions)
    rows = t.oc_mentions.select("doc", "entity", F.col("name").alias("alias")).join(names, ["doc", "entity"]).select(
        F.col("name").alias("id"), "name", "type", "alias", (F.col("doc") * 1000 + F.col("entity")).cast("bigint").alias("seq"))
    late = F.pmod(F.floor(F.col("seq") / 1000), F.lit(2)) == 1
    schema = _parse_datatype_string(en.SIGHTING)
    for part in (rows.filter(late), rows.filter(~late)):
        part.write.mode("append").parquet(f"{root}/in")
        en.stream_entities(read_stream(t.spark, f"{root}/in", schema), f"{root}/out", f"{root}/state").awaitTermination()
    return en.read_entities(t.spark, f"{root}/out").select("id", "type", "first_type", F.array_join("aliases", " | ").alias("aliases"), "first_seq", "last_seq")
