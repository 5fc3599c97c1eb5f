"""Evidence behind relations: cascades over joins, and scores over tokens and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.ordering import prefix_sums, top_per_group
from factloom.operators.docmodel import PAIR, empty_ints, found, span_mass, with_pair_sents
from factloom.session import placed_by

LABEL = ["doc", "label_no"]


ENDS = ["head_id", "tail_id"]


def cooccurrence(labs: DataFrame, ments: DataFrame, ids: DataFrame | None = None, around: bool = False) -> DataFrame:
    """Adds ``together``: the sentences that mention both ends; ``around`` as in ``with_pair_sents``."""
    return (with_pair_sents(labs, ments, ids, around)
            .withColumn("together", F.sort_array(F.array_intersect("hs", "ts"))))


def _bridge() -> Column:
    """The closest (head sentence, tail sentence) of a pair that never shares a sentence, but a third entity; null without one.

    Of a row of ``with_pair_sents(around=True)``. Entities of both ends' sentences are looked up by sentence; the closest pair for one of them is adjacent in the
    merged order of its head and tail sentences, so each costs one sorted pass instead of all sentence pairs.
    """
    near = lambda sents: F.flatten(F.transform(sents, lambda s: found("_l", s, "_in")))
    shared = F.array_except(F.array_intersect(near("hs"), near("ts")), F.array("h", "t"))

    def side(column: str, of: Column, is_head: bool) -> Column:
        return F.transform(F.array_intersect(column, of), lambda s: F.struct(s.alias("pos"), F.lit(is_head).alias("is_head")))

    def step(last: Column, x: Column) -> Column:
        head, tail = F.when(x["is_head"], x["pos"]).otherwise(last["pos"]), F.when(x["is_head"], last["pos"]).otherwise(x["pos"])
        return F.when(last["is_head"] != x["is_head"], F.struct(F.abs(x["pos"] - last["pos"]).alias("dist"), head.alias("hs"), tail.alias("ts")))

    orders = F.transform(F.transform(shared, lambda z: found("_e", z, "_s")), lambda of: F.sort_array(F.concat(side("hs", of, True), side("ts", of, False))))
    best = F.array_min(F.flatten(F.transform(orders, lambda order: F.transform(F.slice(order, 2, F.size(order)), lambda x, i: step(F.get(order, i), x)))))
    return F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), lambda b: F.sort_array(F.array(b["hs"], b["ts"])))


def bridge_sentences(open_pairs: DataFrame, ments: DataFrame) -> DataFrame:
    """Closest (head sentence, tail sentence) that share a third entity, for pairs that never share a sentence.

    ``open_pairs`` carries distinct (doc, h, t, hs, ts). They meet their document's row and nothing else.
    """
    ends = with_pair_sents(open_pairs.select(*PAIR), ments, around=True)
    return ends.select(*PAIR, F.explode(_bridge()).alias("bridge"))


def resolve_evidence(labs: DataFrame, ments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Evidence cascade: given, else shared sentences, else the closest bridge, else none.

    The bridge is sought only for labels that the cheaper branches leave open, in their document's row, so labels are made once and joined with nothing but that row.
    Adds ``ids`` and ``source`` and, with ``ids`` (doc, entity, id), both ends' global ids.
    """
    staged = cooccurrence(labs, ments, ids, around=True)
    given, shared = F.size("evidence") > 0, F.size("together") > 0
    out = staged.withColumn("bridge", F.when(~given & ~shared, F.get(_bridge(), 0)))
    bridged = F.col("bridge").isNotNull()
    return out.select(
        *labs.columns, *(ENDS if ids is not None else []),
        F.when(given, F.col("evidence")).when(shared, F.col("together"))
        .when(bridged, F.col("bridge")).otherwise(empty_ints()).alias("ids"),
        F.when(given, "annotated").when(shared, "inferred_cooccurrence")
        .when(bridged, "inferred_bridge").otherwise("unresolved_multihop").alias("source"))


def resolve_prediction_evidence(preds: DataFrame, ments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Prediction cascade: stored source, else given evidence, else shared sentences, else all mention sentences.

    ``preds``: (doc, h, t, evidence, evidence_source or null) and, if texts were stored, ``stored_texts``; texts without sentence ids
    count as given evidence too. Adds ``ids`` and ``source``.
    """
    staged = cooccurrence(preds, ments, ids)
    stored, given = F.col("evidence_source").isNotNull(), F.size("evidence") > 0
    if "stored_texts" in preds.columns:
        given = given | (F.coalesce(F.size("stored_texts"), F.lit(0)) > 0)
    shared = F.size("together") > 0
    return staged.select(
        *preds.columns, *(ENDS if ids is not None else []),
        F.when(stored | given, F.col("evidence")).when(shared, F.col("together"))
        .otherwise(F.sort_array(F.array_union("hs", "ts"))).alias("ids"),
        F.when(stored, F.col("evidence_source")).when(given, "model_provided")
        .when(shared, "inferred_cooccurrence").otherwise("inferred_mention_union").alias("source"))


def with_evidence_text(df: DataFrame, keys: list[str], sents: DataFrame, ids: str = "ids") -> DataFrame:
    """Adds ``texts``: sentence texts in the order of ``ids``; ids outside the document are dropped.

    Rows with ``stored_texts`` keep these as they are. A document's sentences are gathered, so the rows are shuffled once, by document,
    and not at all where they lie by document already. ``keys`` tell the rows apart.
    """
    texts_of = placed_by(sents.select("doc", "sent_id", "text"), "doc").groupBy("doc").agg(F.collect_list(F.struct("sent_id", "text")).alias("_lines"))
    lines = F.flatten(F.transform(ids, lambda i: F.filter("_lines", lambda x: (x["sent_id"] == i) & x["text"].isNotNull())))
    texts = F.coalesce(F.transform(lines, lambda x: x["text"]), F.expr("cast(array() AS array<string>)"))
    out = df.join(texts_of, "doc", "left").select(*df.columns, texts.alias("texts"))
    if "stored_texts" in df.columns:
        out = out.withColumn("texts", F.when(F.coalesce(F.size("stored_texts"), F.lit(0)) > 0, F.col("stored_texts")).otherwise(F.col("texts")))
    return out


def source_counts(edges: DataFrame, column: str = "source") -> DataFrame:
    return edges.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def evidence_for_predictions(preds: DataFrame, labs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Gold evidence where the predicted triple is gold, else the top-scored sentence of its pair.

    ``scores``: (doc, h, t, sent_id, score); without it ``preds`` carry their pair's as ``scores``, an array of (sent_id, score).
    """
    gold = labs.groupBy(*PAIR, "r").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("gold_ids"))
    if scores is None:
        best = F.array_max(F.transform("scores", lambda s: F.struct(s["score"], (-s["sent_id"]).alias("later"))))
        preds = preds.withColumn("best", -best.getField("later")).drop("scores")
    else:
        top = scores.groupBy(*PAIR).agg(F.max_by("sent_id", F.struct("score", -F.col("sent_id"))).alias("best"))
        preds = preds.join(top, PAIR, "left")
    by_doc = gold.groupBy("doc").agg(F.collect_list(F.struct("h", "t", "r", "gold_ids")).alias("_gold"))
    mine = F.get(F.filter("_gold", lambda g: (g["h"] == F.col("h")) & (g["t"] == F.col("t")) & (g["r"] == F.col("r"))), 0)
    return (preds.join(by_doc, "doc", "left").withColumn("gold_ids", mine.getField("gold_ids")).drop("_gold")
            .withColumn("is_gold", F.col("gold_ids").isNotNull())
            .withColumn("ids", F.when(F.col("is_gold"), F.col("gold_ids"))
                        .when(F.col("best").isNotNull(), F.array("best")).otherwise(empty_ints()))
            .drop("gold_ids", "best"))


def select_by_mean(scores: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Sentences that score at least their own pair's mean, united per document.

    ``scores``: a row per pair and sentence, or a row per pair with ``scores``, an array of (sent_id, score), which is averaged where it is.
    """
    if "scores" in scores.columns:
        total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s["score"])
        return scores.select("doc", "scores", (total / F.size("scores")).alias("mean")).select(
            "doc", F.explode(F.filter("scores", lambda s: s["score"] >= F.col("mean") - tolerance)).alias("s")).select("doc", "s.sent_id").distinct()
    mean = scores.groupBy(*PAIR).agg(F.avg("score").alias("mean"))
    return (scores.join(mean, PAIR).filter(F.col("score") >= F.col("mean") - tolerance)
            .select("doc", "sent_id").distinct())


def select_topk(similar: DataFrame, k: int) -> DataFrame:
    """Top-k sentences per query by similarity: ``similar`` is (query, sent_id, similarity)."""
    return top_per_group(similar, ["query"], [F.desc("similarity"), F.asc("sent_id")], k)


def renormalise(weights: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Weights rescaled within the kept tokens; the original weights where the kept mass vanishes."""
    mass = weights.groupBy(*keys).agg(F.sum(F.when(keep, F.col("weight")).otherwise(0.0)).alias("mass"))
    inside = F.when(keep, F.col("weight") / F.col("mass")).otherwise(0.0)
    return weights.join(mass, keys).withColumn(
        "weight", F.when(F.col("mass") > 1e-12, inside).otherwise(F.col("weight"))).drop("mass")


def _distinct_values(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row per distinct value with both group counts and the counts of smaller values."""
    counts = df.groupBy(F.col(value).alias("value")).agg(
        F.count_if(F.col(flag)).alias("n_yes"), F.count_if(~F.col(flag)).alias("n_no"))
    return prefix_sums(counts, "value", ["n_yes", "n_no"])


def score_profile(df: DataFrame, value: str, flag: str, probs: dict[str, float]) -> DataFrame:
    """Per group: count, mean and exact interpolated percentiles.

    Percentiles read the distinct-value table at the two neighbouring ranks, so no group is gathered in one task.
    """
    values = _distinct_values(df, value, flag)
    both = values.select("value", F.explode(F.array(
        F.struct(F.lit(True).alias(flag), F.col("n_yes").alias("n"), F.col("before_n_yes").alias("b")),
        F.struct(F.lit(False).alias(flag), F.col("n_no").alias("n"), F.col("before_n_no").alias("b")))).alias("g")).select(
        "value", "g.*").filter("n > 0")
    base = df.groupBy(flag).agg(F.count("*").alias("n_total"), F.avg(value).alias("mean"))
    picks = []
    for name, p in probs.items():
        rank = (F.col("n_total") - 1) * F.lit(float(p))
        hit = lambda r: (F.col("b") <= r) & (r < F.col("b") + F.col("n"))
        low = F.max(F.when(hit(F.floor(rank)), F.col("value")))
        high = F.max(F.when(hit(F.ceil(rank)), F.col("value")))
        picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(name))
    at = both.join(base.select(flag, "n_total"), flag).groupBy(flag).agg(*picks)
    return base.join(at, flag).withColumnRenamed("n_total", "n")


def prune_impact(tokens: DataFrame, rates: tuple[float, ...]) -> DataFrame:
    """Mean share of evidence / other tokens dropped when each document loses its lowest-scoring share of tokens.

    ``tokens``: (doc, score, is_evidence). Documents without one of the groups do not count for it.
    """
    cuts = tokens.groupBy("doc").agg(F.percentile("score", F.array(*[F.lit(r) for r in rates])).alias("cuts"))
    dropped = [(F.col("score") < F.get("cuts", i)).cast("double") for i in range(len(rates))]
    shares = tokens.join(cuts, "doc").groupBy("doc").agg(*[c for i, d in enumerate(dropped) for c in (
        F.avg(F.when(F.col("is_evidence"), d)).alias(f"ev{i}"), F.avg(F.when(~F.col("is_evidence"), d)).alias(f"other{i}"))])
    per_doc = shares.select("doc", F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"ev{i}").alias("ev"), F.col(f"other{i}").alias("other"))
                                                      for i, r in enumerate(rates)])))
    return per_doc.groupBy("rate").agg(F.avg("ev").alias("evidence_dropped"), F.avg("other").alias("other_dropped"),
                                       F.count("ev").alias("n_docs"))


def mann_whitney_u(df: DataFrame, value: str, flag: str) -> DataFrame:
    """U of the flagged group, the tie-corrected z and the two-sided normal p, from the distinct-value table."""
    values = _distinct_values(df, value, flag)
    total, smaller = F.col("n_yes") + F.col("n_no"), F.col("before_n_yes") + F.col("before_n_no")
    mean_rank = smaller + (total + 1) / 2.0
    sums = values.agg(F.sum("n_yes").cast("double").alias("n1"), F.sum("n_no").cast("double").alias("n2"),
                      F.sum(F.col("n_yes") * mean_rank).alias("rank_sum"),
                      F.sum((total * total * total - total).cast("double")).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = sums.select(n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u.alias("u"),
                      F.when(sigma > 0, (u - n1 * n2 / 2) / sigma).alias("z"))
    return out.withColumn("p", normal_tail(F.col("z")))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal by the Abramowitz-Stegun 7.1.26 approximation of erfc (|error| < 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    # fixed values: the approximation's coefficients
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return poly * F.exp(-x * x)


def blend_evidence(weights: DataFrame, spans: DataFrame, keys: list[str], g: float) -> DataFrame:
    """``(1-g) * token weight + g * its sentence's share spread evenly over the sentence``, renormalised per key.

    ``weights``: (keys, position, weight) with the sentence id; ``spans``: sentence spans. A key's tokens, one document's, are added up by windows, so nothing is
    joined with its own totals.
    """
    mass = span_mass(weights.select(*keys, "position", "weight"), spans, keys)
    total = lambda column: F.sum(column).over(W.partitionBy(*keys)) + 1e-30
    spread = mass.select(*keys, "sent_id", (F.col("mass") / total("mass") / F.greatest(F.col("end") - F.col("start"), F.lit(1))).alias("spread"))
    mixed = weights.withColumn("w_total", total("weight")).join(spread, [*keys, "sent_id"]).withColumn(
        "mixed", (1 - g) * F.col("weight") / F.col("w_total") + g * F.col("spread"))
    return mixed.select(*keys, "sent_id", "position", (F.col("mixed") / total("mixed")).alias("weight"))
