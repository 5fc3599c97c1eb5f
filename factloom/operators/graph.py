"""The global graph: entities merged across documents, one edge per relation and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import global_entity_id, is_revised, relation_slug
from factloom.operators.evidence import with_evidence_text

EDGE_KEY = ["head_id", "relation_type", "tail_id", "document"]


def with_entity_ids(canon: DataFrame) -> DataFrame:
    return canon.withColumn("id", global_entity_id(F.col("name"), F.col("type")))


def build_entities(ments: DataFrame, canon: DataFrame) -> DataFrame:
    """Entities merge on canonical name and type over all documents; aliases are their distinct mention names.

    Names are made distinct before they are gathered, so a name that fills a third of the corpus costs one row.
    """
    ids = with_entity_ids(canon)
    named = (ments.select("doc", "entity", F.col("name").alias("alias"))
             .join(ids.select("doc", "entity", "id", "name", "type"), ["doc", "entity"])
             .select("id", "name", "type", "alias").distinct())
    return named.groupBy("id", "name", "type").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))


def with_relation_name(df: DataFrame, relations: DataFrame, code: str = "r", name: str = "relation_name") -> DataFrame:
    """Relation name from the dictionary; where it is missing the row's ``own_name``, if it has one, else the code itself."""
    names = relations.select(F.col("code").alias(code), F.col("name").alias("_name"))
    own = ["own_name"] if "own_name" in df.columns else []
    return df.join(names, code, "left").withColumn(name, F.coalesce("_name", *own, code)).drop("_name", *own)


def build_edges(resolved: DataFrame, relations: DataFrame, splits: DataFrame, sents: DataFrame) -> DataFrame:
    """Gold edges: one per label and document, confidence 1.

    ``resolved``: labels with both ends' ids, ``ids`` and ``source``. Sentence texts join last, so they are shuffled once.
    """
    named = with_relation_name(resolved, relations).join(splits, "doc")
    rows = with_evidence_text(named, ["doc", "label_no"], sents)
    return rows.select(
        "head_id", "tail_id", F.col("r").alias("relation_id"), "relation_name",
        relation_slug(F.col("relation_name")).alias("relation_type"), F.lit(1.0).alias("confidence"), "split",
        F.col("doc").alias("document"), "label_no", F.col("ids").alias("sentence_id"),
        F.col("texts").alias("evidence"), F.col("source").alias("evidence_source"), is_revised(F.col("split")).alias("is_revised"))


def build_prediction_edges(resolved: DataFrame, relations: DataFrame, model: str, sents: DataFrame) -> DataFrame:
    """Predicted edges with their evidence texts.

    ``resolved``: the prediction cascade's rows with both ends' ids, confidence, band and action; optionally ``stored_texts`` and ``own_name``.
    """
    rows = with_evidence_text(with_relation_name(resolved, relations), ["doc", "h", "t", "r"], sents)
    return rows.select(
        "head_id", "tail_id", F.col("r").alias("relation_id"), "relation_name",
        relation_slug(F.col("relation_name")).alias("relation_type"), "confidence",
        F.lit("predicted").alias("split"), F.col("doc").alias("document"), F.col("ids").alias("sentence_id"), F.col("texts").alias("evidence"),
        F.col("source").alias("evidence_source"), F.lit(False).alias("is_revised"), F.lit(model).alias("model"),
        F.col("band").alias("filter_band"), F.col("action").alias("filter_action"))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, as a partial aggregate: repeated keys shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def upsert_edges(base: DataFrame, new: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Merge edges on (head, type, tail, document): later rows overwrite properties, a re-run adds nothing.

    Rows carry a unique ``seq`` within their table; every row of ``new`` is later than every row of ``base``.
    """
    both = base.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys or EDGE_KEY, ["_batch", seq]).drop("_batch")


def upsert_entities(base: DataFrame, new: DataFrame) -> DataFrame:
    """Merge nodes on id: name, type and aliases of the later batch win (so a changed type moves the label)."""
    both = base.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, ["id"], ["_batch"]).drop("_batch")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.explode(F.array("head_id", "tail_id")).alias("id")).distinct()
    return entities.join(used, "id", "left_anti")


def overlay_stats(base: DataFrame, new: DataFrame) -> DataFrame:
    """How many entities of ``new`` are new and how many merge into existing ones."""
    both = (base.select("id", F.lit(True).alias("in_base")).join(
        new.select("id", F.lit(True).alias("in_new")), "id", "full_outer"))
    old, incoming = F.col("in_base").isNotNull(), F.col("in_new").isNotNull()
    return both.agg(F.count_if(incoming & ~old).alias("added"), F.count_if(incoming & old).alias("merged"),
                    F.count_if(old & ~incoming).alias("untouched"))


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, n): entities per type, edges per relation type, distinct documents."""
    by_type = entities.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n"))
    by_relation = edges.groupBy(F.col("relation_type").alias("key")).agg(F.count("*").alias("n"))
    documents = edges.select("document").distinct().agg(F.count("*").alias("n"))
    return (by_type.select(F.lit("entity_type").alias("kind"), "key", "n")
            .unionByName(by_relation.select(F.lit("relation_type").alias("kind"), "key", "n"))
            .unionByName(documents.select(F.lit("documents").alias("kind"), F.lit("all").alias("key"), "n")))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges per node: parallel edges count, a self loop once."""
    ends = F.when(F.col("head_id") == F.col("tail_id"), F.array("head_id")).otherwise(F.array("head_id", "tail_id"))
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def incidence(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Every edge seen from both ends, as distinct (node, head, relation, tail, evidence, next_id) with end names."""
    names = entities.select("id", "name")
    named = (edges.select("head_id", "relation_type", "tail_id", "evidence").distinct()
             .join(names.select(F.col("id").alias("head_id"), F.col("name").alias("head")), "head_id")
             .join(names.select(F.col("id").alias("tail_id"), F.col("name").alias("tail")), "tail_id"))
    seen = F.inline(F.array(F.struct(F.col("head_id").alias("node"), F.col("tail_id").alias("next_id")),
                            F.struct(F.col("tail_id").alias("node"), F.col("head_id").alias("next_id"))))
    return named.select("head", F.col("relation_type").alias("relation"), "tail", "evidence", seen).distinct().select(
        "node", "head", "relation", "tail", "evidence", "next_id")


def ends_joined(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with name and type of both ends."""
    ends = entities.select("id", "name", "type")
    return (edges.join(ends.select(F.col("id").alias("head_id"), F.col("name").alias("head_name"),
                                   F.col("type").alias("head_type")), "head_id")
            .join(ends.select(F.col("id").alias("tail_id"), F.col("name").alias("tail_name"),
                              F.col("type").alias("tail_type")), "tail_id"))
