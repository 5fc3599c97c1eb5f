"""From logits to triples: decoding, fusion, denoising, confidence bands and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.ordering import top_per_group
from factloom.operators.docmodel import PAIR, found, renumbered
from factloom.session import placed_by, stored

NO_RELATION = 0


def with_threshold(logits: DataFrame, k: int | None = None) -> DataFrame:
    """Adds each pair's class-0 logit ``th`` and whether the class ``fits`` the pair's top ``k`` logits, ties kept.

    The top ``k`` are taken over *all* classes, class 0 included. ``logits``: a row per class (doc, h, t, class_id, logit), or a row per pair with
    ``logits``, an array in the order of the class ids, as classifiers emit them. A pair's array is unfolded where it is; of class rows
    the window's group is the class set, one shuffle serves threshold, rank and everything derived from them.
    """
    if "logits" in logits.columns:
        kth = F.when(F.size("logits") >= k, F.get(F.sort_array("logits", asc=False), k - 1)) if k else F.lit(None)
        rest = [c for c in logits.columns if c != "logits"]
        rows = logits.select(*rest, kth.alias("_kth"), F.get("logits", NO_RELATION).alias("th"), F.posexplode("logits").alias("class_id", "logit"))
        fits = F.coalesce(F.col("logit") >= F.col("_kth"), F.lit(True)) if k else F.lit(True)
        return rows.withColumn("fits", fits).select(*rest, "class_id", "logit", "fits", "th")
    pair = W.partitionBy(*PAIR)
    th = F.max(F.when(F.col("class_id") == NO_RELATION, F.col("logit"))).over(pair)
    fits = F.rank().over(pair.orderBy(F.desc("logit"))) <= k if k else F.lit(True)
    return logits.withColumn("fits", fits).withColumn("th", th)


def _largest(logits: str) -> Column:
    """The largest logit of a pair's classes other than class 0."""
    return F.array_max(F.slice(logits, NO_RELATION + 2, F.size(logits)))


def decode_adaptive(logits: DataFrame, k: int | None = None, na: bool = False) -> DataFrame:
    """Classes whose logit exceeds the pair's class-0 logit, at most the top ``k`` with ties kept; adds ``margin``.

    With ``na``, a pair for which nothing is decoded yields its class 0.
    """
    beats = (F.col("class_id") > NO_RELATION) & (F.col("logit") > F.col("th")) & F.col("fits")
    if na and "logits" in logits.columns:
        # a class beats class 0 and is among the top k exactly if the largest logit does
        logits = logits.withColumn("any", F.coalesce(_largest("logits") > F.get("logits", NO_RELATION), F.lit(False)))
    elif "logits" in logits.columns:
        logits = logits.filter(_largest("logits") > F.get("logits", NO_RELATION))  # pairs without such a class are never unfolded
    out = with_threshold(logits, k).withColumn("beats", beats)
    keep, own = F.col("beats"), {*PAIR, "class_id", "logit", "logits", "any"}
    rest = [c for c in logits.columns if c not in own]
    if na:
        if "any" not in out.columns:
            out = out.withColumn("any", F.max("beats").over(W.partitionBy(*PAIR)))
        keep = keep | ((F.col("class_id") == NO_RELATION) & ~F.col("any"))
    return out.filter(keep).select(*PAIR, "class_id", (F.col("logit") - F.col("th")).alias("margin"), *rest)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decode_sigmoid(logits: DataFrame, threshold: float, k: int | None = None) -> DataFrame:
    """Classes above a fixed probability, at most the top ``k`` with ties kept; class 0 is never emitted by this rule."""
    if "logits" in logits.columns:
        logits = logits.filter(sigmoid(_largest("logits")) > threshold)
    base = with_threshold(logits, k).filter("fits") if k or "logits" in logits.columns else logits
    return base.filter((F.col("class_id") > NO_RELATION) & (sigmoid(F.col("logit")) > threshold)).select(*PAIR, "class_id")


def confidence(margin: Column) -> Column:
    return F.round(sigmoid(margin), 4)


def assemble_triples(preds: DataFrame, canon: DataFrame, relations: DataFrame) -> DataFrame:
    """Rich nested triples. ``preds``: (doc, h, t, class_id, r, margin, is_gold, ids, texts). A document's names are gathered, so triples travel by document only."""
    node = F.struct(F.concat(F.lit("E"), "entity").alias("id"), F.col("name"), F.col("type"))
    names = placed_by(canon.select("doc", F.struct("entity", node.alias("node")).alias("_n")), "doc").groupBy("doc").agg(F.collect_list("_n").alias("_names"))
    names = names.select("doc", F.col("_names.entity").alias("_e"), F.col("_names.node").alias("_nodes"))
    at = lambda end: found("_e", F.col(end), "_nodes")
    out = (preds.join(names, "doc").withColumn("head", at("h")).withColumn("tail", at("t")).filter("head IS NOT NULL AND tail IS NOT NULL").drop("_e", "_nodes")
           .join(relations.select(F.col("code").alias("r"), F.col("name").alias("relation_name")), "r", "left"))
    from factloom.functions.text import readable_relation
    relation = F.struct(F.concat(F.lit("R"), "class_id").alias("id"),
                        readable_relation(F.coalesce("relation_name", "r")).alias("name"), F.col("r").alias("code"))
    source = F.struct(F.col("doc").cast("string").alias("document_id"), F.col("ids").alias("sentence_id"),
                      F.col("is_gold").alias("is_revised"))
    return out.select("head", relation.alias("relation"), "tail", confidence(F.col("margin")).alias("confidence"),
                      source.alias("source"), F.col("texts").alias("evidence"))


def denoise(labs: DataFrame, preds: DataFrame) -> DataFrame:
    """Distant labels that the model predicts as well."""
    return labs.join(preds.select(*PAIR, "r").distinct(), [*PAIR, "r"], "left_semi")


def denoised_pairs(labs: DataFrame, preds: DataFrame, class_ids: DataFrame) -> DataFrame:
    """Per labelled pair the sorted class ids of its surviving labels; ``[0]`` where none survives, so no pair gets lost."""
    found = labs.join(preds.select(*PAIR, "r").distinct().withColumn("_hit", F.lit(True)), [*PAIR, "r"], "left")
    kept = found.join(class_ids.select(F.col("code").alias("r"), "class_id"), "r").groupBy(*PAIR).agg(
        F.sort_array(F.collect_set(F.when(F.col("_hit"), F.col("class_id")))).alias("ids"))
    return kept.select(*PAIR, F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(0))).alias("class_ids"))


def denoise_counts(labs: DataFrame, preds: DataFrame) -> DataFrame:
    """How many labels the model's predictions keep and drop."""
    found = labs.join(preds.select(*PAIR, "r").distinct().withColumn("_hit", F.lit(True)), [*PAIR, "r"], "left")
    return found.agg(F.count("_hit").alias("n_kept"), (F.count("*") - F.count("_hit")).alias("n_dropped"))


def confidence_band(conf: Column, high: float, low: float) -> Column:
    return F.when(conf >= high, "high").when(conf >= low, "mid").otherwise("low")


def apply_band_verdicts(triples: DataFrame, verdicts: DataFrame | None, key: str, high: float, low: float) -> DataFrame:
    """Keep the high band, and the mid band's accepted rows; a missing verdict rejects, no verdict table keeps high only.

    ``verdicts``: (key, accept, reason). Adds ``band``, ``action`` and ``reason``.
    """
    banded = triples.withColumn("band", confidence_band(F.col("confidence"), high, low)).filter("band <> 'low'")
    if verdicts is None:
        return banded.filter("band = 'high'").withColumn("action", F.lit("pass")).withColumn("reason", F.lit(None).cast("string"))
    joined = banded.join(verdicts.select(key, "accept", F.col("reason").alias("reason")), key, "left")
    accepted = F.coalesce("accept", F.lit(False))
    return (joined.filter((F.col("band") == "high") | accepted)
            .withColumn("action", F.when(F.col("band") == "high", "pass").otherwise("accept"))
            .withColumn("reason", F.when(F.col("band") == "mid", F.col("reason"))).drop("accept"))


def fuse_logits(full: DataFrame, sub: DataFrame, gamma: float | Column, entity_map: DataFrame) -> DataFrame:
    """``full + sub - gamma`` where the sub-document holds the pair, else ``full``.

    ``sub`` uses the sub-document's entity ids; ``entity_map`` is (doc, entity, new_entity). Both have a row per class (doc, h, t, class_id, logit), or a row per
    pair with ``logits``, an array in the order of the class ids, and so has the result; arrays meet once for all classes of a pair.
    """
    if "logits" in full.columns:
        moved = renumbered(sub.withColumnRenamed("logits", "sub_logits"), entity_map, "new_entity", "entity")
        less = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
        fused = F.transform("logits", lambda x, i: F.coalesce(x + F.get("sub_logits", i) - less, x))
        return full.join(moved, PAIR, "left").select(*PAIR, F.when(F.col("sub_logits").isNull(), F.col("logits")).otherwise(fused).alias("logits"))
    back = entity_map.select("doc", "entity", "new_entity")
    moved = (sub.withColumnRenamed("logit", "sub_logit")
             .join(back.select("doc", F.col("entity").alias("oh"), F.col("new_entity").alias("h")), ["doc", "h"])
             .join(back.select("doc", F.col("entity").alias("ot"), F.col("new_entity").alias("t")), ["doc", "t"])
             .select("doc", F.col("oh").alias("h"), F.col("ot").alias("t"), "class_id", "sub_logit"))
    gamma = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return full.join(moved, [*PAIR, "class_id"], "left").withColumn(
        "logit", F.when(F.col("sub_logit").isNotNull(), F.col("logit") + F.col("sub_logit") - gamma)
        .otherwise(F.col("logit"))).select(*PAIR, "class_id", "logit")


def sweep(scored: DataFrame, gold: DataFrame, grid: tuple[float, ...], keep) -> DataFrame:
    """P/R/F1 for every grid value in one pass over the scored triples.

    ``scored`` is one row per candidate (doc, h, t, r, ...); ``keep(row columns, value)`` says whether a grid value
    predicts it. All grid values are counted side by side in one aggregate, so the data is read and joined once. Rows that no value predicts
    count nowhere and go before the join.
    """
    predicted = scored.filter(reduce(lambda a, b: a | b, [keep(v) for v in grid]))
    hit = predicted.join(gold.select(*PAIR, "r").distinct().withColumn("_gold", F.lit(True)), [*PAIR, "r"], "left")
    right = F.coalesce("_gold", F.lit(False))
    counts = hit.agg(*[c for i, v in enumerate(grid) for c in (
        F.count_if(keep(v)).alias(f"p{i}"), F.count_if(keep(v) & right).alias(f"c{i}"))])
    n_gold = gold.select(*PAIR, "r").distinct().agg(F.count("*").alias("n_gold"))
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(float(v)).alias("value"), F.col(f"p{i}").alias("n_pred"),
                                       F.col(f"c{i}").alias("n_correct")) for i, v in enumerate(grid)]))
    one = counts.select(rows).withColumn("_one", F.lit(1)).join(n_gold.withColumn("_one", F.lit(1)), "_one").drop("_one")
    from factloom.operators.evaluate import prf
    return prf(one, "n_correct", "n_pred", "n_gold")


def best_of(swept: DataFrame) -> DataFrame:
    """The grid value with the best F1; the first of the grid wins ties."""
    return swept.agg(F.max_by(F.struct("value", "precision", "recall", "f1"), F.struct("f1", -F.col("pos"))).alias("b")).select("b.*")


def first_value_over(rows: DataFrame, column: str, budget: int, bins: int = 1024) -> tuple[object, int] | None:
    """The smallest value of a number column up to which at least ``budget`` rows lie, and how many lie below it; None where there are fewer rows.

    A histogram of at most ``bins`` rows narrows the range to one bin, again and again until the bin holds one value, so nothing is sorted.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < budget or not budget:
        return None
    below = 0
    while low != high:
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.when(F.col(column) > F.lit(low), 1).otherwise(0)
        inside = rows.filter((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        for _, n, least, most in sorted(tuple(r) for r in inside.groupBy(place.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect()):
            if below + n >= budget:
                low, high = least, most
                break
            below += n
    return low, below


def uncertain_packs(decision: DataFrame, margin: float, budget: int, per_pack: int = 20) -> DataFrame:
    """Class rows within ``margin`` of the threshold, packed per document for ``budget`` calls: adds ``side``, ``pack``, ``place`` in it, ``asked``.

    A document's rows fill packs of ``per_pack``, closest to the threshold first; the packs with the closest rows are asked, ties by document, then by
    pack, exactly ``budget`` of them (or all). The others stay in the result with ``asked`` false, so a cut is seen.
    """
    near = decision.filter(F.abs("margin") < margin).withColumn("side", F.when(F.col("margin") > 0, "above").otherwise("below"))
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.abs(F.col("margin")), "h", "t", "class_id")) - 1
    rows = stored(near.withColumn("rank", rank).withColumn("pack", F.floor(F.col("rank") / per_pack)).withColumn("place", F.col("rank") % per_pack).drop("rank"), "near")
    packs = rows.filter("place = 0").select("doc", "pack", F.abs("margin").alias("closest"))  # a pack's first row is its closest
    edge = first_value_over(packs, "closest", budget)
    if edge is None:
        return rows.withColumn("asked", F.lit(budget > 0))
    closest, below = edge
    asked = F.col("closest") < F.lit(closest)
    tied = packs.filter(F.col("closest") == F.lit(closest))
    doc, before = first_value_over(tied, "doc", budget - below)
    last = tied.filter(F.col("doc") == F.lit(doc)).orderBy("pack").limit(budget - below - before)  # packs of one document
    chosen = packs.filter(asked).unionByName(tied.filter(F.col("doc") < F.lit(doc))).unionByName(last).select("doc", "pack", F.lit(True).alias("asked"))
    return rows.join(chosen, ["doc", "pack"], "left").fillna(False, ["asked"])


def type_constraints(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: the tail type is one the relation permits; relations without a rule permit all."""
    rule = rules.groupBy("r").agg(F.collect_set("tail_type").alias("types"))
    return triples.join(rule, "r", "left").withColumn(
        "allowed", F.col("types").isNull() | F.array_contains("types", F.col("tail_type"))).drop("types")


def reuse_known(unsure: DataFrame, facts: DataFrame) -> DataFrame:
    """Uncertain triples whose (head name, relation, tail name) is already confident elsewhere."""
    return unsure.join(facts.select("head_name", "r", "tail_name").distinct(), ["head_name", "r", "tail_name"], "left_semi")


def transition(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold triples by whether run ``a`` and run ``b`` predict them: both, rescued (only b), lost (only a), neither."""
    key = [*PAIR, "r"]
    flags = (gold.select(*key).distinct()
             .join(a.select(*key).distinct().withColumn("in_a", F.lit(True)), key, "left")
             .join(b.select(*key).distinct().withColumn("in_b", F.lit(True)), key, "left"))
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    kind = F.when(in_a & in_b, "both").when(in_b, "rescued").when(in_a, "lost").otherwise("neither")
    return flags.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def net_gain(outcomes: DataFrame) -> DataFrame:
    """Rescued less lost gold triples of a transition table."""
    def n(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome") == kind, F.col("n"))), F.lit(0))

    return outcomes.agg(n("rescued").alias("rescued"), n("lost").alias("lost"), (n("rescued") - n("lost")).alias("net_gain"))
