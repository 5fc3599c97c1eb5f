"""Graph repair: over-merged, under-merged and wrongly linked entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import strip_legal_suffix, value_key
from factloom.operators.graph import EDGE_KEY, latest_per_key
from factloom.schemas import ENTITY_TYPES, FUNCTIONAL_FOR_MERGE, FUNCTIONAL_RELATIONS, GEO_RELATIONS, HIERARCHY_RELATIONS
from factloom.session import checkpointed, stored


# --- over-merged entities ----------------------------------------------------------------------------------------
def occurrences(named_edges: DataFrame, functional: tuple[str, ...] = FUNCTIONAL_RELATIONS) -> DataFrame:
    """One value per entity, functional relation and document: the smallest (value, evidence)."""
    rows = named_edges.filter(F.col("relation_type").isin(*functional))
    return rows.groupBy(F.col("head_id").alias("id"), "relation_type", "document").agg(
        F.min(F.struct(F.col("tail_name").alias("value"), "evidence")).alias("o")).select(
        "id", "relation_type", "document", "o.value", "o.evidence")


def conflict_candidates(named_edges: DataFrame, functional: tuple[str, ...] = FUNCTIONAL_RELATIONS) -> DataFrame:
    """Entities with at least two distinct value keys on a functional relation: (id, relation_type, n_keys, n_documents).

    Aggregated per key first, so an entity with a third of all documents shrinks to its few keys before the shuffle.
    """
    keyed = occurrences(named_edges, functional).withColumn("key", value_key(F.col("value")))
    per_key = keyed.groupBy("id", "relation_type", "key").agg(F.count("*").alias("n"))
    return per_key.groupBy("id", "relation_type").agg(
        F.count("*").alias("n_keys"), F.sum("n").alias("n_documents")).filter("n_keys >= 2")


def valid_groups(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, relation_type, document, gid) of usable verdicts.

    ``candidates``: (id, relation_type, documents) with the documents in the order that was judged; ``verdicts``:
    (id, relation_type, group_ids). A verdict of the wrong length, or one that puts all in one group, is discarded.
    """
    both = candidates.join(verdicts, ["id", "relation_type"]).filter(
        (F.size("documents") == F.size("group_ids")) & (F.size(F.array_distinct("group_ids")) > 1))
    zipped = F.arrays_zip(F.col("documents").alias("document"), F.col("group_ids").alias("gid"))
    return both.select("id", "relation_type", F.inline(zipped))


def split_targets(groups: DataFrame) -> DataFrame:
    """(id, document, new_id): the smallest group keeps the node, each other becomes ``id#<slug of its first document>``."""
    keep = groups.groupBy("id").agg(F.min("gid").alias("keep"))
    first = groups.groupBy("id", "gid").agg(F.min("document").alias("first"))
    slug = F.regexp_replace(F.regexp_replace("first", "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    target = first.join(keep, "id").withColumn(
        "new_id", F.when(F.col("gid") == F.col("keep"), F.col("id")).otherwise(F.concat("id", F.lit("#"), slug)))
    return groups.join(target.select("id", "gid", "new_id"), ["id", "gid"]).select("id", "document", "new_id")


def split_entities(entities: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split by a document -> group mapping (id, document, gid): both ends of all edges of a document move.

    Entities of unknown type are left alone. New nodes copy name, type and every other column.
    """
    known = entities.filter(F.col("type").isin(*ENTITY_TYPES)).select("id")
    targets = split_targets(groups.join(known, "id", "left_semi")).filter("new_id <> id")
    out = edges
    for end in ("head_id", "tail_id"):
        moves = targets.select(F.col("id").alias(end), "document", F.col("new_id").alias("_to"))
        out = out.join(moves, [end, "document"], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    added = entities.join(targets.select("id", "new_id").distinct(), "id").withColumn("id", F.col("new_id")).select(*entities.columns)
    return entities.unionByName(added.join(entities.select("id"), "id", "left_anti")), out.select(*edges.columns)


# --- under-merged entities ---------------------------------------------------------------------------------------
def suffix_candidates(entities: DataFrame) -> DataFrame:
    """ORG pairs "A" / "A + legal suffix": (short_id, short_name, long_id, long_name), each unordered pair once."""
    orgs = entities.filter("type = 'ORG'")
    short = orgs.groupBy(F.col("name").alias("short_name")).agg(F.max("id").alias("short_id"))
    long = orgs.select(F.col("id").alias("long_id"), F.col("name").alias("long_name"), strip_legal_suffix(F.col("name")).alias("short_name"))
    return (long.filter("short_name <> '' AND short_name <> long_name").join(short, "short_name")
            .dropDuplicates(["short_id", "long_id"]).select("short_id", "short_name", "long_id", "long_name"))


def topology_gate(cands: DataFrame, edges: DataFrame, override: list[tuple[str, str]] = ()) -> DataFrame:
    """Adds ``gate``: ``reject`` when a hierarchy edge links the pair, ``override`` when listed, else ``open``."""
    pair = lambda a, b: F.sort_array(F.array(a, b))
    linked = (edges.filter(F.col("relation_type").isin(*HIERARCHY_RELATIONS))
              .select(pair("head_id", "tail_id").alias("pair")).distinct().withColumn("linked", F.lit(True)))
    listed = F.lit(False)
    for short, long in override:
        listed = listed | ((F.col("short_name") == short) & (F.col("long_name") == long))
    out = cands.withColumn("pair", pair("short_id", "long_id")).join(linked, "pair", "left")
    gate = F.when(F.col("linked") & listed, "override").when(F.col("linked"), "reject").otherwise("open")
    return out.withColumn("gate", gate).drop("pair", "linked")


def rule_verdict(cands: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Adds ``verdict``: reject on a functional conflict, merge on a shared value, merge on a shared neighbour, else undecided.

    ``neighbours``: distinct (node, relation, name). Overlap is counted by equi-joins on the value, so a hub's
    neighbours never form one array.
    """
    near = neighbours.select("node", "relation", "name").distinct()
    pair = ["short_id", "long_id"]
    ids = cands.select(*pair)
    short = ids.join(near.withColumnRenamed("node", "short_id"), "short_id")
    long = ids.join(near.withColumnRenamed("node", "long_id"), "long_id")
    agreeing = short.join(long, [*pair, "relation", "name"]).select(*pair, "relation").distinct().withColumn("agrees", F.lit(1))
    shared = short.select(*pair, "relation").distinct().join(long.select(*pair, "relation").distinct(), [*pair, "relation"])
    per_pair = (shared.join(agreeing, [*pair, "relation"], "left").groupBy(*pair).agg(
        F.max("agrees").alias("agree"),
        F.max(F.when(F.col("relation").isin(*FUNCTIONAL_FOR_MERGE) & F.col("agrees").isNull(), 1)).alias("conflict")))
    overlap = short.select(*pair, "name").distinct().join(long.select(*pair, "name").distinct(), [*pair, "name"]) \
        .select(*pair).distinct().withColumn("overlap", F.lit(1))
    verdict = (F.when(F.col("conflict") == 1, "reject").when(F.col("agree") == 1, "merge")
               .when(F.col("overlap") == 1, "merge").otherwise("undecided"))
    return (cands.join(per_pair, pair, "left").join(overlap, pair, "left")
            .withColumn("verdict", verdict).drop("agree", "conflict", "overlap"))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component) over undirected (a, b) pairs: smallest id as label, with pointer jumping, so rounds grow with the
    logarithm of a chain's length. Each round is checkpointed."""
    arcs = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("peer")),
                                         F.struct(F.col("b").alias("id"), F.col("a").alias("peer"))))).distinct().persist()
    labels = checkpointed(arcs.groupBy("id").agg(F.least(F.min("peer"), F.first("id")).alias("component")))
    while True:
        seen = arcs.join(labels.select(F.col("id").alias("peer"), F.col("component").alias("_c")), "peer") \
            .groupBy("id").agg(F.min("_c").alias("_near"))
        nearer = labels.join(seen, "id").select("id", F.least("component", "_near").alias("component"))
        jump = nearer.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        jumped = checkpointed(nearer.join(jump, "component").select("id", F.least("component", "_root").alias("component")))
        before = labels.withColumnRenamed("component", "_old")
        changed = not jumped.join(before, "id").filter("component <> _old").isEmpty()
        labels = jumped
        if not changed:
            arcs.unpersist()
            return labels


def merge_plan(pairs: DataFrame, entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """(drop_id, keep_id) for accepted (short_id, long_id) pairs.

    Per connected component the node with the highest degree is kept; ties go to the longer name, then the larger id.
    """
    members = connected_components(pairs.select(F.col("short_id").alias("a"), F.col("long_id").alias("b")))
    ranked = (members.join(entities.select("id", "name"), "id").join(degrees, "id", "left")
              .withColumn("rank", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.char_length("name").alias("length"), "id")))
    keep = ranked.groupBy("component").agg(F.max("rank").alias("best")).select("component", F.col("best.id").alias("keep_id"))
    return ranked.join(keep, "component").filter("id <> keep_id").select(F.col("id").alias("drop_id"), "keep_id")


def apply_merges(entities: DataFrame, edges: DataFrame, plan: DataFrame, key: str = "document") -> tuple[DataFrame, DataFrame]:
    """Rewire both ends, drop merged nodes, unite aliases plus the dropped names.

    ``key='document'`` keeps parallel edges of different documents; ``'pair'`` merges them into the latest one.
    """
    out = edges.withColumn("_seq", F.struct("head_id", "tail_id", "document"))
    for end in ("head_id", "tail_id"):
        moves = plan.select(F.col("drop_id").alias(end), F.col("keep_id").alias("_to"))
        out = out.join(moves, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    keys = EDGE_KEY if key == "document" else ["head_id", "relation_type", "tail_id"]
    moved_edges = latest_per_key(out, keys, ["_seq"]).select(*edges.columns)
    named = entities.join(plan.withColumnRenamed("drop_id", "id"), "id", "left")
    gained = (named.filter("keep_id IS NOT NULL")
              .select(F.col("keep_id").alias("id"), F.explode(F.array_union("aliases", F.array("name"))).alias("alias")))
    own = named.filter("keep_id IS NULL")
    united = (own.select("id", F.explode_outer("aliases").alias("alias")).join(gained.select("id").distinct(), "id", "left_semi")
              .unionByName(gained).filter("alias IS NOT NULL").distinct()
              .groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("_aliases")))
    moved_entities = own.join(united, "id", "left").withColumn("aliases", F.coalesce("_aliases", "aliases"))
    return moved_entities.select(*entities.columns), moved_edges


# --- wrongly linked demonyms -------------------------------------------------------------------------------------
def demonym_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    schema = T.StructType([T.StructField("demonym", T.StringType()), T.StructField("place", T.StringType())])
    return spark.createDataFrame(sorted(mapping.items()), schema)


def demonym_candidates(named_edges: DataFrame, entities: DataFrame, demonyms: DataFrame) -> DataFrame:
    """Geographic edges with a demonym typed LOC at one end (tail first) whose place exists as LOC.

    Adds ``side``, ``wrong_name`` and ``canonical_id``.
    """
    places = entities.filter("type = 'LOC'").groupBy(F.col("name").alias("place")).agg(F.min("id").alias("canonical_id"))
    known = demonyms.join(places, "place").select("demonym", "canonical_id")
    geo = named_edges.filter(F.col("relation_type").isin(*GEO_RELATIONS))
    # tail first: an edge takes its head only when its tail is no demonym typed LOC
    listed = demonyms.select(F.col("demonym").alias("tail_name"), F.lit(True).alias("_listed")).distinct()
    tail = (F.col("tail_type") == "LOC") & F.col("_listed")
    sided = (geo.join(listed, "tail_name", "left")
             .withColumn("side", F.when(tail, "tail").when(F.col("head_type") == "LOC", "head")).filter("side IS NOT NULL")
             .withColumn("wrong_name", F.when(F.col("side") == "tail", F.col("tail_name")).otherwise(F.col("head_name"))))
    return sided.join(known.withColumnRenamed("demonym", "wrong_name"), "wrong_name").select(
        "edge_id", "relation_type", "side", "wrong_name", "canonical_id", "document")


def parse_verdicts(batches: DataFrame) -> DataFrame:
    """(batch, idx, verdict) from raw answers (batch, n, raw): a JSON array of n strings, else all ``no``.

    Anything but ``yes`` is ``no``.
    """
    parsed = F.from_json("raw", T.ArrayType(T.StringType()))
    fallback = F.array_repeat(F.lit("no"), F.col("n").cast("int"))
    answers = F.when(F.size(parsed) == F.col("n"), parsed).otherwise(fallback)
    return batches.select("batch", F.posexplode(answers).alias("idx", "word")).select(
        "batch", "idx", F.when(F.lower(F.trim("word")) == "yes", "yes").otherwise("no").alias("verdict"))


def repoint(edges: DataFrame, cands: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all edges with one end repointed where the verdict is yes, ungrounded candidates). Nodes stay.

    ``verdicts``: (edge_id, verdict); a missing verdict counts as no.
    """
    judged = cands.join(verdicts, "edge_id", "left").withColumn("yes", F.coalesce(F.col("verdict") == "yes", F.lit(False)))
    moves = judged.filter("yes").select("edge_id", "side", F.col("canonical_id").alias("_to"))
    moved = edges.join(moves, "edge_id", "left")
    for side in ("head", "tail"):
        moved = moved.withColumn(f"{side}_id", F.when(F.col("side") == side, F.col("_to")).otherwise(F.col(f"{side}_id")))
    return moved.select(*edges.columns), judged.filter("NOT yes").select(*cands.columns)


# --- reports -----------------------------------------------------------------------------------------------------
def type_split_report(entities: DataFrame) -> DataFrame:
    """Names that occur under several types."""
    return entities.select("name", "type").distinct().groupBy("name").agg(
        F.count("*").alias("n_types"), F.array_join(F.sort_array(F.collect_list("type")), ",").alias("types")).filter("n_types > 1")


HUB = 10_000  # first edges into a centre that one task joins


def open_triangles(edges: DataFrame, first: str, second: str, closing: str, hub: int | None = None) -> DataFrame:
    """A -first-> B -second-> C without A -closing-> C: (a, b, c).

    The first edges of a centre B of more than ``hub`` are dealt into parts by A, and its second edges go to each part, so a centre with a third of all
    edges is many tasks.
    """
    of = lambda kind, x, y: edges.filter(F.col("relation_type") == kind).select(
        F.col("head_id").alias(x), F.col("tail_id").alias(y)).distinct()
    hub = hub or HUB
    into, out = of(first, "a", "b"), of(second, "b", "c")
    heavy = into.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("b", F.ceil(F.col("n") / hub).cast("int").alias("parts"))
    heavy = stored(heavy, "hubs")  # at most a row for each ``hub`` edges
    parts = F.coalesce("parts", F.lit(1))
    left = into.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    right = out.join(heavy, "b", "left").select("b", "c", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    paths = left.join(right, ["b", "part"]).filter("a <> c").select("a", "b", "c")
    return paths.join(of(closing, "a", "c"), ["a", "c"], "left_anti").select("a", "b", "c")
