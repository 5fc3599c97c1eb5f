"""Scoring of extracted triples and of retrieval. Triples are (doc, h, t, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.docmodel import PAIR, with_pair_sents
from factloom.session import stored

TRIPLE = [*PAIR, "r"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf(df: DataFrame, correct: str, pred: str, gold: str) -> DataFrame:
    out = (df.withColumn("precision", F.coalesce(ratio(F.col(correct), F.col(pred)), F.lit(0.0)))
           .withColumn("recall", F.coalesce(ratio(F.col(correct), F.col(gold)), F.lit(0.0))))
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def judged(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct predicted and gold triples side by side: flags ``pred`` and ``gold``."""
    p = preds.select(*TRIPLE).distinct().withColumn("pred", F.lit(True))
    g = gold.select(*TRIPLE).distinct().withColumn("gold", F.lit(True))
    return p.join(g, TRIPLE, "full_outer").fillna(False, ["pred", "gold"])


def _counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if("pred").alias("n_pred"), F.count_if("gold").alias("n_gold"),
                                 F.count_if(F.col("pred") & F.col("gold")).alias("n_correct"))


def score(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1. Predictions of unknown documents stay in the precision denominator."""
    return prf(_counts(judged(preds, gold)), "n_correct", "n_pred", "n_gold")


def _names(ments: DataFrame) -> DataFrame:
    return ments.select("doc", "entity", "name").distinct()


def _with_names(triples: DataFrame, ments: DataFrame) -> DataFrame:
    names = _names(ments)
    return (triples.join(names.select("doc", F.col("entity").alias("h"), F.col("name").alias("head_name")), ["doc", "h"])
            .join(names.select("doc", F.col("entity").alias("t"), F.col("name").alias("tail_name")), ["doc", "t"]))


def train_facts(labs: DataFrame, ments: DataFrame) -> DataFrame:
    """All (head mention name, tail mention name, relation) of every label, distinct."""
    return _with_names(labs.select(*TRIPLE).distinct(), ments).select("head_name", "tail_name", "r").distinct()


def seen_in(triples: DataFrame, ments: DataFrame, facts: DataFrame) -> DataFrame:
    """Triples for which any pair of mention names is a known fact."""
    return (_with_names(triples.select(*TRIPLE), ments)
            .join(facts.select("head_name", "tail_name", "r"), ["head_name", "tail_name", "r"], "left_semi")
            .select(*TRIPLE).distinct())


def score_ign(preds: DataFrame, gold: DataFrame, ments: DataFrame, facts: DataFrame) -> DataFrame:
    """Plain scores plus Ign precision and F1: correct triples already known from training leave precision only."""
    rows = judged(preds, gold)
    known = seen_in(rows.filter("pred AND gold"), ments, facts).withColumn("known", F.lit(True))
    counts = rows.join(known, TRIPLE, "left").agg(
        F.count_if("pred").alias("n_pred"), F.count_if("gold").alias("n_gold"),
        F.count_if(F.col("pred") & F.col("gold")).alias("n_correct"), F.count_if("known").alias("n_known"))
    out = prf(counts, "n_correct", "n_pred", "n_gold").withColumn(
        "ign_precision", ratio(F.col("n_correct") - F.col("n_known"), F.col("n_pred") - F.col("n_known")))
    return out.withColumn("ign_f1", harmonic(F.col("ign_precision"), F.col("recall")))


def score_official(preds: DataFrame, labs: DataFrame, docs: DataFrame, ments: DataFrame, annotated: DataFrame,
                   distant: DataFrame) -> DataFrame:
    """The benchmark's scorer: relation, evidence and two Ign scores in one row.

    ``preds``: (doc, h, t, r, evidence, pos), duplicates keep the smallest ``pos``. Of repeated labels the last one's
    evidence counts, while the evidence total counts every label. Evidence of unknown documents does not count.
    """
    first = preds.groupBy(*TRIPLE).agg(F.min_by("evidence", "pos").alias("evidence")).withColumn("pred", F.lit(True))
    gold = labs.groupBy(*TRIPLE).agg(F.max_by("evidence", "label_no").alias("gold_evidence"),
                                     F.sum(F.size("evidence")).alias("n_evidence")).withColumn("gold", F.lit(True))
    rows = first.join(gold, TRIPLE, "full_outer").join(docs.select("doc").distinct().withColumn("known_doc", F.lit(True)), "doc", "left")
    both = rows.filter("pred AND gold").select(*TRIPLE)
    in_a = seen_in(both, ments, annotated).withColumn("in_a", F.lit(True))
    in_d = seen_in(both, ments, distant).withColumn("in_d", F.lit(True))
    evidence = F.array_distinct("evidence")
    c = (rows.join(in_a, TRIPLE, "left").join(in_d, TRIPLE, "left").agg(
        F.count_if("pred").alias("n_pred"), F.count_if("gold").alias("n_gold"), F.count_if(F.col("pred") & F.col("gold")).alias("n_correct"),
        F.sum(F.when(F.col("pred") & F.col("known_doc"), F.size(evidence)).otherwise(0)).alias("pred_evidence"),
        F.sum(F.coalesce("n_evidence", F.lit(0))).alias("gold_evidence_total"),
        F.sum(F.when(F.col("pred") & F.col("gold"), F.size(F.array_intersect("gold_evidence", evidence))).otherwise(0)).alias("hit_evidence"),
        F.count_if("in_a").alias("n_a"), F.count_if("in_d").alias("n_d")))
    out = prf(c, "n_correct", "n_pred", "n_gold")
    e_p, e_r = ratio(F.col("hit_evidence"), F.col("pred_evidence")), ratio(F.col("hit_evidence"), F.col("gold_evidence_total"))
    ign = lambda n: harmonic(ratio(F.col("n_correct") - F.col(n), F.col("n_pred") - F.col(n)), F.col("recall"))
    return out.withColumn("evidence_f1", harmonic(e_p, e_r)).withColumn("ign_annotated_f1", ign("n_a")).withColumn(
        "ign_distant_f1", ign("n_d"))


def score_per_relation(preds: DataFrame, gold: DataFrame) -> DataFrame:
    return prf(_counts(judged(preds, gold), "r"), "n_correct", "n_pred", "n_gold")


def score_by_locality(preds: DataFrame, gold: DataFrame, ments: DataFrame) -> DataFrame:
    """Scores split by whether any sentence mentions both ends."""
    rows = with_pair_sents(judged(preds, gold), ments).withColumn(
        "locality", F.when(F.arrays_overlap("hs", "ts"), "intra").otherwise("inter"))
    return prf(_counts(rows, "locality"), "n_correct", "n_pred", "n_gold")


def score_by_frequency(preds: DataFrame, gold: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """Scores split into relations that hold at least ``share`` of the counted labels and the long tail.

    ``counts``: (r, n), one row per relation of the dictionary.
    """
    total = counts.agg(F.sum("n").alias("total"))
    frequent = counts.filter(F.col("n") >= share * total.scalar()).select("r").withColumn("frequent", F.lit(True))
    per_relation = _counts(judged(preds, gold), "r").join(frequent, "r", "left")  # a row for each relation: no triple meets a relation's key
    band = F.when(F.col("frequent"), "frequent").otherwise("long_tail").alias("band")
    counts = per_relation.groupBy(band).agg(*[F.sum(n).alias(n) for n in ("n_pred", "n_gold", "n_correct")])
    return prf(counts, "n_correct", "n_pred", "n_gold")


def distant_audit(pairs: DataFrame, ments: DataFrame, facts: DataFrame, gold: DataFrame) -> DataFrame:
    """What labelling by name facts would find: (outcome, n) with caught, missed and false_positive.

    Names that are no fact's head (tail) go before they meet the pairs, so that of the pairs only those travel by their names that have two known ends.
    """
    facts = stored(facts.select("head_name", "tail_name", "r"), "facts")
    end = lambda column, name: _names(ments).withColumnsRenamed({"entity": column, "name": name}).join(facts.select(name).distinct(), name, "left_semi")
    named = pairs.select(*PAIR).join(end("h", "head_name"), ["doc", "h"]).join(end("t", "tail_name"), ["doc", "t"])
    labelled = named.join(facts, ["head_name", "tail_name"]).select(*TRIPLE)
    rows = judged(labelled, gold)
    outcome = F.when(F.col("pred") & F.col("gold"), "caught").when(F.col("gold"), "missed").otherwise("false_positive")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def leakage(titles_a: DataFrame, titles_b: DataFrame, gold_b: DataFrame, ments_b: DataFrame, facts_a: DataFrame) -> DataFrame:
    """One row: titles shared by two splits, and how many gold triples of the second are facts of the first."""
    shared = titles_a.select("title").intersect(titles_b.select("title")).agg(F.count("*").alias("n"))
    gold = gold_b.select(*TRIPLE).distinct()
    seen = seen_in(gold, ments_b, facts_a).withColumn("seen", F.lit(True))
    out = gold.join(seen, TRIPLE, "left").agg(F.count("*").alias("n_gold"), F.count_if("seen").alias("n_seen"))
    return out.select("n_gold", "n_seen", ratio(F.col("n_seen"), F.col("n_gold")).alias("seen_share"),
                      shared.scalar().alias("shared_titles"))


def match_facts(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``gold_idx``: the first gold fact with equal (head, relation, tail) or equal evidence, null without one.

    ``retrieved``: (question_id, pos, head, relation, tail, evidence); ``gold``: the same with gold_idx.
    """
    key = lambda df: df.withColumn("_h", F.lower("head")).withColumn("_t", F.lower("tail"))
    by_triple = key(retrieved).join(key(gold).select("question_id", "_h", "relation", "_t", "gold_idx"),
                                    ["question_id", "_h", "relation", "_t"]).select("question_id", "pos", "gold_idx")
    by_evidence = retrieved.filter("evidence <> ''").join(gold.select("question_id", "evidence", "gold_idx"), ["question_id", "evidence"]) \
        .select("question_id", "pos", "gold_idx")
    first = by_triple.unionByName(by_evidence).groupBy("question_id", "pos").agg(F.min("gold_idx").alias("gold_idx"))
    return retrieved.join(first, ["question_id", "pos"], "left")


def match_chunks(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``gold_idx`` to (question_id, pos, text): the first gold evidence that contains or is contained in the text.

    Texts compare in their normal form; the index counts only gold rows with evidence.
    """
    from factloom.functions.text import normal_sentence
    with_text = gold.filter("evidence <> ''").withColumn("idx", (F.row_number().over(
        W.partitionBy("question_id").orderBy("gold_idx")) - 1)).select("question_id", "idx", normal_sentence(F.col("evidence")).alias("ge"))
    normal = chunks.select("question_id", "pos", normal_sentence(F.col("text")).alias("ct"))
    first = (normal.join(with_text, "question_id").filter(F.contains("ge", "ct") | F.contains("ct", "ge"))
             .groupBy("question_id", "pos").agg(F.min("idx").alias("gold_idx")))
    return chunks.join(first, ["question_id", "pos"], "left")


def retrieval_metrics(matched: DataFrame, n_gold: DataFrame) -> DataFrame:
    """Precision, recall, F1, nDCG and AP per question.

    ``matched``: (question_id, pos from 0, gold_idx or null); ``n_gold``: (question_id, n_gold), at least 1 counts.
    Precision counts every hit; the others only the first hit of each gold item. A question without results scores 0.
    """
    key = W.partitionBy("question_id", "gold_idx")
    flagged = matched.withColumn("hit", F.col("gold_idx").isNotNull()).withColumn(
        "first", F.when(F.col("hit") & (F.col("pos") == F.min("pos").over(key)), 1).otherwise(0))
    hits = F.sum("first").over(W.partitionBy("question_id").orderBy("pos"))
    gain = 1 / F.log2(F.col("pos") + 2.0)
    per = flagged.withColumn("hits", hits).groupBy("question_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), F.sum("first").alias("n_first"),
        F.sum(F.when(F.col("first") == 1, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("first") == 1, F.col("hits") / (F.col("pos") + 1)).otherwise(0.0)).alias("ap_sum"))
    joined = n_gold.select("question_id", F.greatest("n_gold", F.lit(1)).alias("g")).join(per, "question_id", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("g", "n"), F.lit(1)).cast("int")), F.lit(0.0),
                        lambda s, i: s + 1 / F.log2(i + 1.0))
    out = joined.select("question_id", ratio(F.col("n_hit"), F.col("n")).alias("precision"), ratio(F.col("n_first"), F.col("g")).alias("recall"),
                        F.when(F.col("n") == 0, 0.0).otherwise(F.col("dcg") / ideal).alias("ndcg"), (F.col("ap_sum") / F.col("g")).alias("ap"))
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def macro_average(rows: DataFrame, metrics: list[str], by: str = "system") -> DataFrame:
    """Mean of each metric per system; nulls do not count."""
    return rows.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics])


def resolve_gold(gold: DataFrame, named_edges: DataFrame) -> DataFrame:
    """Gold triples by name with the evidence of an edge between the two, either direction; null without one."""
    both = named_edges.select("relation_type", "evidence", F.inline(F.array(
        F.struct(F.col("head_name").alias("head"), F.col("tail_name").alias("tail")),
        F.struct(F.col("tail_name").alias("head"), F.col("head_name").alias("tail")))))
    found = both.groupBy("head", F.col("relation_type").alias("relation"), "tail").agg(F.min("evidence").alias("evidence"))
    return gold.join(found, ["head", "relation", "tail"], "left")


def improvements(history: DataFrame, block: int = 4096) -> DataFrame:
    """Epochs whose F1 exceeds every earlier one of the run: block maxima are carried, so a long run is many tasks."""
    blocked = history.withColumn("_b", F.floor(F.col("epoch") / block))
    peak = F.max("f1").over(W.partitionBy("run", "_b").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
    carry = blocked.groupBy("run", "_b").agg(F.max("f1").alias("_m")).select(
        "run", "_b", F.max("_m").over(W.partitionBy("run").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_c"))
    lowest = F.lit(-1.0)
    rows = blocked.withColumn("_p", peak).join(carry, ["run", "_b"])
    return rows.filter(F.col("f1") > F.greatest(F.coalesce("_p", lowest), F.coalesce("_c", lowest))).select("run", "epoch", "f1")


def select_run(history: DataFrame, patience: int) -> DataFrame:
    """Per run: epoch at which training stops and the best epoch up to it (first wins).

    Training stops at the first epoch that lies ``patience`` epochs behind the last improvement.
    """
    last = history.groupBy("run").agg(F.max("epoch").alias("last_epoch"))
    nxt = F.lead("epoch").over(W.partitionBy("run").orderBy("epoch"))
    gaps = improvements(history).withColumn("next", nxt).join(last, "run")
    stale = F.coalesce("next", F.col("last_epoch") + 1) > F.col("epoch") + patience
    stop = gaps.groupBy("run").agg(F.min(F.when(stale, F.col("epoch") + patience)).alias("stop"), F.max("last_epoch").alias("last_epoch"))
    stop = stop.select("run", F.least(F.coalesce("stop", "last_epoch"), "last_epoch").alias("stop_epoch"),
                       F.coalesce(F.col("stop") <= F.col("last_epoch"), F.lit(False)).alias("stopped_early"))
    best = gaps.join(stop, "run").filter(F.col("epoch") <= F.col("stop_epoch")).groupBy("run").agg(
        F.max_by(F.struct("epoch", "f1"), "epoch").alias("b"))
    return stop.join(best, "run").select("run", "stop_epoch", "stopped_early", F.col("b.epoch").alias("best_epoch"), F.col("b.f1").alias("best_f1"))


def accepted(score_col: str, target: float | Column, share: float = 0.9) -> Column:
    """Acceptance rule: at least ``share`` of the published figure."""
    return F.col(score_col) >= share * target


def compare_runs(scores: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """Systems by F1 with the difference to a baseline system. ``scores``: one row per system."""
    ref = scores.filter(F.col("system") == base)
    deltas = [(F.col(m) - ref.select(m).scalar()).alias(f"delta_{m}") for m in metrics]
    return scores.select("*", *deltas).orderBy(F.desc("f1"), "system")


def prediction_diff(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """(in_a, in_b, correct, n) over the triples either system predicts."""
    p = a.select(*TRIPLE).distinct().withColumn("in_a", F.lit(True)).join(
        b.select(*TRIPLE).distinct().withColumn("in_b", F.lit(True)), TRIPLE, "full_outer")
    rows = p.join(gold.select(*TRIPLE).distinct().withColumn("correct", F.lit(True)), TRIPLE, "left").fillna(False, ["in_a", "in_b", "correct"])
    return rows.groupBy("in_a", "in_b", "correct").agg(F.count("*").alias("n"))
