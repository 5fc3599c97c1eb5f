"""Document model: sentences, mentions, labels, spans, pairs and in-document graphs.

Keys: ``doc`` a document, ``entity`` a mention cluster within it, ``sent_id`` a sentence within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.ordering import running_total
from factloom.functions.text import normalize_name
from factloom.session import placed_by, stored

PAIR = ["doc", "h", "t"]


def empty_ints() -> Column:
    return F.expr("cast(array() AS array<int>)")


def found(keys: Column | str, key: Column, values: Column | str) -> Column:
    """What stands in ``values`` where ``key`` stands in ``keys``, both arrays; null where it does not. Compiled, unlike a filter by a lambda."""
    return F.get(values, (F.array_position(keys, key) - 1).cast("int"))


def sentences(docs: DataFrame) -> DataFrame:
    exploded = docs.select("doc", F.posexplode("sents").alias("sent_id", "tokens"))
    return exploded.withColumn("text", F.array_join("tokens", " "))


def mentions(docs: DataFrame) -> DataFrame:
    clusters = docs.select("doc", F.posexplode("vertexSet").alias("entity", "cluster"))
    return (clusters.select("doc", "entity", F.posexplode("cluster").alias("mention", "m"))
            .select("doc", "entity", "mention", "m.name", "m.sent_id", F.col("m.pos")[0].alias("start_w"),
                    F.col("m.pos")[1].alias("end_w"), "m.type"))


def labels(docs: DataFrame) -> DataFrame:
    """One row per label; a document without the field has none."""
    return (docs.select("doc", F.posexplode("labels").alias("label_no", "l"))
            .select("doc", "label_no", "l.h", "l.t", "l.r", F.coalesce("l.evidence", empty_ints()).alias("evidence")))


def canonical(ments: DataFrame, rule: str = "mode") -> DataFrame:
    """Representative name and type per cluster.

    ``mode``: most frequent normalised name and, independently, type; first seen wins ties. ``first``: the most
    frequent raw name and the first mention's type.

    Mentions are counted per distinct (name, type) before a cluster's variants meet, so a cluster that fills a third of
    the corpus shuffles as its few variants.
    """
    name = F.col("name") if rule == "first" else normalize_name(F.col("name"))
    counted = (ments.select("doc", "entity", "mention", name.alias("name"), "type").groupBy("doc", "entity", "name", "type")
               .agg(F.count("*").alias("n"), F.min("mention").alias("first")))
    variants = counted.groupBy("doc", "entity").agg(F.collect_list(F.struct("name", "type", "n", "first")).alias("v"))

    one = lambda field, several: F.when(F.size("v") == 1, F.get("v", 0).getField(field)).otherwise(several)

    def most_frequent(field: str) -> Column:
        def total(x: Column) -> Column:
            same = F.filter("v", lambda y: y[field] == x[field])
            return F.struct(F.aggregate(same, F.lit(0).cast("bigint"), lambda s, y: s + y["n"]).alias("n"),
                            (-F.array_min(F.transform(same, lambda y: y["first"]))).alias("first"), x[field].alias("value"))
        return one(field, F.array_max(F.transform("v", total)).getField("value"))

    first = one("type", F.array_min(F.transform("v", lambda x: F.struct(x["first"].alias("first"), x["type"].alias("value")))).getField("value"))
    return variants.select("doc", "entity", most_frequent("name").alias("name"),
                           (first if rule == "first" else most_frequent("type")).alias("type"))


def entity_sents(ments: DataFrame) -> DataFrame:
    return ments.groupBy("doc", "entity").agg(F.sort_array(F.collect_set("sent_id")).alias("sents"))


def sent_entities(ments: DataFrame) -> DataFrame:
    return ments.groupBy("doc", "sent_id").agg(F.sort_array(F.collect_set("entity")).alias("entities"))


def word_offsets(sents: DataFrame) -> DataFrame:
    """Position of each sentence's first word in the flattened document."""
    sized = sents.select("doc", "sent_id", F.size("tokens").alias("n_tokens"))
    return running_total(sized, ["doc"], "sent_id", F.col("n_tokens"), "offset")


def mention_spans(ments: DataFrame, offsets: DataFrame, max_len: int) -> DataFrame:
    """Document-level word span of every mention; ``kept`` is false where it leaves the length limit."""
    spans = ments.join(offsets.select("doc", "sent_id", "offset"), ["doc", "sent_id"])
    start, end = F.col("offset") + F.col("start_w"), F.col("offset") + F.col("end_w")
    return spans.select("doc", "entity", "mention", start.alias("start"), end.alias("end"),
                        (end <= max_len).alias("kept"))


def marked_tokens(sents: DataFrame, ments: DataFrame, marker: str = "*") -> DataFrame:
    """Every word with its markers and its position in the marked document.

    A word carries one opening (closing) marker however many mentions start (end) there.
    """
    marks = ments.groupBy("doc", "sent_id").agg(F.collect_set("start_w").alias("_opens"), F.collect_set(F.col("end_w") - 1).alias("_closes"))
    inside = lambda c: F.filter(F.coalesce(c, empty_ints()), lambda w: (w >= 0) & (w < F.size("tokens")))
    marked = sents.filter("doc IS NOT NULL AND sent_id IS NOT NULL AND size(tokens) > 0").join(marks, ["doc", "sent_id"], "left").select(
        "doc", "sent_id", "tokens", inside("_opens").alias("_opens"), inside("_closes").alias("_closes"))
    marked = running_total(marked.withColumn("sent_width", (F.size("tokens") + F.size("_opens") + F.size("_closes")).cast("bigint")), ["doc"], "sent_id", F.col("sent_width"), "sent_start")
    # both kinds of marks before each word, so that a word's place needs no other word's row
    earlier = F.transform("tokens", lambda _, i: (i + F.size(F.filter("_opens", lambda w: w < i)) + F.size(F.filter("_closes", lambda w: w < i))).cast("bigint"))
    words = marked.withColumn("_places", earlier).select("*", F.posexplode("tokens").alias("w", "token"))
    opens, closes = F.array_contains("_opens", F.col("w")), F.array_contains("_closes", F.col("w"))
    piece = F.concat(F.when(opens, F.lit(marker + " ")).otherwise(""), F.col("token"), F.when(closes, F.lit(" " + marker)).otherwise(""))
    return words.select("doc", "sent_id", "w", "token", piece.alias("piece"), (1 + opens.cast("int") + closes.cast("int")).alias("width"), "sent_start", "sent_width",
                        (F.col("sent_start") + F.get("_places", F.col("w"))).alias("position"))


def marked_sentences(marked: DataFrame) -> DataFrame:
    return (marked.groupBy("doc", "sent_id")
            .agg(F.array_join(F.sort_array(F.collect_list(F.struct("w", "piece"))).getField("piece"), " ").alias("text"),
                 F.max("sent_start").alias("start"),
                 F.max(F.col("sent_start") + F.col("sent_width")).alias("end")))


def marked_spans(marked: DataFrame, ments: DataFrame) -> DataFrame:
    """Mention spans in marked positions: opening marker to one past the closing marker."""
    word = F.struct("w", F.col("position").alias("start"), (F.col("position") + F.col("width")).alias("end"))
    words = marked.groupBy("doc", "sent_id").agg(F.collect_list(word).alias("_w")).select(
        "doc", "sent_id", F.col("_w.w").alias("_w"), F.col("_w.start").alias("_starts"), F.col("_w.end").alias("_ends"))
    start, end = found("_w", F.col("start_w"), "_starts"), found("_w", F.col("end_w") - 1, "_ends")
    return ments.join(words, ["doc", "sent_id"]).select("doc", "entity", "mention", start.alias("start"), end.alias("end")).filter("start IS NOT NULL AND `end` IS NOT NULL")


def doc_entities(ments: DataFrame, *about: str) -> DataFrame:
    """(doc, es): a document's entities in order, each with ``sents``, its sorted sentences, or ``spans``, its sorted (sent_id, start_w, end_w), where ``about`` names them.

    One shuffle, of the mentions by document; none where they are read from buckets by document.
    """
    gathered = {"sents": F.sort_array(F.collect_set("sent_id")), "spans": F.sort_array(F.collect_set(F.struct("sent_id", "start_w", "end_w")))}
    needs = {"sents": ["sent_id"], "spans": ["sent_id", "start_w", "end_w"]}
    placed = placed_by(ments.filter("doc IS NOT NULL").select("doc", "entity", *dict.fromkeys(c for a in about for c in needs[a])), "doc")
    ents = placed.groupBy("doc", "entity")
    ents = ents.agg(*[gathered[a].alias(a) for a in about]) if about else placed.distinct()
    return ents.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("entity", *about))).alias("es"))


def doc_sentences(ments: DataFrame) -> DataFrame:
    """(doc, _l, _in): a document's sentences with mentions, and the entities of each."""
    placed = placed_by(ments.filter("doc IS NOT NULL AND sent_id IS NOT NULL").select("doc", "sent_id", "entity"), "doc")
    lines = sent_entities(placed).groupBy("doc").agg(F.collect_list(F.struct("sent_id", "entities")).alias("_lines"))
    return lines.select("doc", F.col("_lines.sent_id").alias("_l"), F.col("_lines.entities").alias("_in"))


def renumbered(pairs: DataFrame, ids: DataFrame, was: str, now: str) -> DataFrame:
    """``pairs`` with both ends under their ids ``now`` instead of ``was``, columns of ``ids`` (doc, was, now) that tell a document's entities apart; pairs with an end that has none go.

    A document's ids are gathered and hashed, so the pairs are not sorted.
    """
    by_doc = placed_by(ids.select("doc", was, now), "doc").groupBy("doc").agg(F.collect_list(F.struct(was, now)).alias("_ids"))
    by_doc = by_doc.select("doc", F.col(f"_ids.{was}").alias("_was"), F.col(f"_ids.{now}").alias("_now"))
    moved = {end: found("_was", F.col(end), "_now").alias(end) for end in ("h", "t")}
    return pairs.join(by_doc.hint("shuffle_hash"), "doc").select(*[moved.get(c, F.col(c)) for c in pairs.columns]).filter("h IS NOT NULL AND t IS NOT NULL")


def paired(docs: DataFrame, about: tuple[str, ...] = (), facts: str | None = None) -> DataFrame:
    """All ordered pairs of different entities of the documents of ``doc_entities``; they stay in the task of their document.

    Columns doc, h, t; with ``about``, what each end carries: ``hs``, ``ts`` (sents), ``hp``, ``tp`` (spans). ``facts`` names a column of ``docs``, an array of
    structs with fields h and t: each pair gets those about it.
    """
    short = {"sents": "s", "spans": "p"}
    kept = lambda end: [F.col(f"_{end}.{a}").alias(f"{end}{short[a]}") for a in about]
    heads = docs.select("doc", "es", *([facts] if facts else []), F.explode("es").alias("_h")).select(
        "doc", "es", F.col("_h.entity").alias("h"), *kept("h"), *([F.filter(facts, lambda f: f["h"] == F.col("_h.entity")).alias(facts)] if facts else []))
    if facts:
        heads = heads.withColumn("_known", F.col(f"{facts}.t"))  # most pairs have no facts: that is seen here, without a lambda for each of a head's facts
    pairs = heads.select(*[c for c in heads.columns if c != "es"], F.explode("es").alias("_t")).filter(F.col("_t.entity") != F.col("h"))
    mine = [F.when(F.array_contains("_known", F.col("_t.entity")), F.filter(facts, lambda f: f["t"] == F.col("_t.entity"))).otherwise(
        F.slice(facts, 1, 0)).alias(facts)] if facts else []
    return pairs.select("doc", "h", F.col("_t.entity").alias("t"), *[F.col(f"h{short[a]}") for a in about], *kept("t"), *mine)


def candidate_pairs(ments: DataFrame, *about: str) -> DataFrame:
    """All ordered pairs of different entities of a document: the classifier's input, quadratic by definition. ``about``: as in ``paired``."""
    return paired(doc_entities(ments, *about), about)


def candidate_facts(ments: DataFrame, facts: DataFrame) -> DataFrame:
    """All candidate pairs with ``facts``, the rows of ``facts`` (doc, h, t, ...) about that pair; only mentions and facts are shuffled, by document."""
    known = facts.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in facts.columns if c != "doc"])).alias("facts"))
    docs = doc_entities(ments).join(known, "doc", "left")
    return paired(docs.withColumn("facts", F.coalesce("facts", F.array())), facts="facts")


def pair_labels(pairs: DataFrame | None, labs: DataFrame, rel_ids: DataFrame, ments: DataFrame | None = None) -> DataFrame:
    """Sorted class ids per pair (``[0]`` without a label) and the union of evidence over its relations; without ``pairs``, of all candidate pairs of ``ments``."""
    per_pair = (labs.join(rel_ids.withColumnRenamed("code", "r"), "r")
                .groupBy(*PAIR).agg(F.sort_array(F.collect_set("class_id")).alias("class_ids"),
                                    F.sort_array(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence")))
    if pairs is None:
        found = candidate_facts(ments, per_pair).withColumn("_own", F.get("facts", 0)).select(*PAIR, "_own.class_ids", "_own.evidence")
    else:
        found = pairs.join(per_pair, PAIR, "left")
    return found.select(
        *PAIR, F.coalesce("class_ids", F.array(F.lit(0))).alias("class_ids"),
        F.coalesce("evidence", empty_ints()).alias("evidence"))


def multi_hot(class_ids: Column, n_classes: int) -> Column:
    return F.array(*[F.array_contains(class_ids, F.lit(i)).cast("int") for i in range(n_classes)])


def clamp_evidence(evidence: Column, n_sents: Column) -> Column:
    return F.filter(evidence, lambda s: (s >= 0) & (s < n_sents))


def doc_relations(labs: DataFrame, rel_ids: DataFrame) -> DataFrame:
    return (labs.join(rel_ids.withColumnRenamed("code", "r"), "r").groupBy("doc")
            .agg(F.sort_array(F.collect_set("class_id")).alias("class_ids")))


def distance_bucket(distance: Column, scheme: str) -> Column:
    """``range``: 0, 1, 2, 3-4, 5-8, 9+ as 0..5; ``cap``: the distance itself, at most 5."""
    if scheme == "cap":
        return F.least(distance, F.lit(5))
    return (F.when(distance <= 2, distance).when(distance <= 4, F.lit(3)).when(distance <= 8, F.lit(4))
            .otherwise(F.lit(5)))


def with_pair_sents(pairs: DataFrame, ments: DataFrame, ids: DataFrame | None = None, around: bool = False) -> DataFrame:
    """Adds the sorted sentence sets ``hs`` and ``ts`` of both ends and, with ``ids`` (doc, entity, id), their global ids.

    A document's entities are gathered, so the pairs are shuffled once, by document, for both ends and the ids. Pairs that carry both sets stay as they are.
    ``around`` keeps the document beside each pair: its entities ``_e`` with their sentences ``_s``, and its sentences ``_l`` with their entities ``_in``.
    """
    if ids is None and not around and {"hs", "ts"} <= set(pairs.columns):
        return pairs
    ends = doc_entities(ments, "sents").select("doc", F.col("es.entity").alias("_e"), F.col("es.sents").alias("_s"))
    added = ["hs", "ts"]
    if around:
        ends = ends.join(doc_sentences(ments), "doc")
        added += ["_e", "_s", "_l", "_in"]
    if ids is not None:
        named = placed_by(ids.select("doc", "entity", "id"), "doc").groupBy("doc").agg(F.collect_list(F.struct("entity", "id")).alias("_ids"))
        ends = ends.join(named.select("doc", F.col("_ids.entity").alias("_ie"), F.col("_ids.id").alias("_id")), "doc")
        added += ["head_id", "tail_id"]
    at = lambda end: found("_e", F.col(end), "_s")
    out = pairs.join(ends, "doc").select("*", at("h").alias("hs"), at("t").alias("ts"))
    if ids is not None:
        out = out.select("*", found("_ie", F.col("h"), "_id").alias("head_id"), found("_ie", F.col("t"), "_id").alias("tail_id"))
        # an end without its row in ids goes, one whose id is null stays
        out = out.filter(F.array_contains("_ie", F.col("h")) & F.array_contains("_ie", F.col("t")))
    return out.filter("hs IS NOT NULL AND ts IS NOT NULL").select(*pairs.columns, *added)


def pair_distance(pairs: DataFrame, ments: DataFrame, *kept: str) -> DataFrame:
    """Smallest sentence distance of a pair, with both bucketings; ``kept`` columns of ``pairs`` stay."""
    closest = F.when((F.size("hs") == 1) & (F.size("ts") == 1), F.abs(F.get("hs", 0) - F.get("ts", 0))).otherwise(F.array_min(F.transform(
        F.col("hs"), lambda a: F.array_min(F.transform(F.col("ts"), lambda b: F.abs(a - b))))))
    return with_pair_sents(pairs, ments).select(*PAIR, *kept, closest.alias("distance")).select(
        "*", distance_bucket(F.col("distance"), "range").alias("range_bucket"),
        distance_bucket(F.col("distance"), "cap").alias("cap_bucket"))


def edge_category(ments: DataFrame) -> DataFrame:
    """Entity pairs that share a sentence: 2 when two mention spans overlap, else 1.

    An interval join: equality on (doc, sentence) places it, the overlap test runs as part of the aggregate. Pairs
    absent from the result have category 0.
    """
    spans = ments.select("doc", "sent_id", "entity", "start_w", "end_w")
    left = spans.toDF("doc", "sent_id", "h", "a1", "b1")
    right = spans.toDF("doc", "sent_id", "t", "a2", "b2")
    overlap = (F.col("a1") < F.col("b2")) & (F.col("a2") < F.col("b1"))
    return (left.join(right, ["doc", "sent_id"]).filter("h <> t")
            .groupBy(*PAIR).agg(F.max(F.when(overlap, 2).otherwise(1)).alias("category")))


def doc_graph(pairs: DataFrame, ments: DataFrame, sents: DataFrame) -> DataFrame:
    """Sparse entity + sentence graph: typed nodes ``E<i>`` / ``S<i>``, category and distance bucket per edge.

    Pairs that share a sentence are at distance 0, so pairs that carry their ends' sentences and spans compare spans there only and are not shuffled.
    """
    ent, sen = (lambda c: F.concat(F.lit("E"), c)), (lambda c: F.concat(F.lit("S"), c))
    overlap = F.exists("hp", lambda a: F.exists("tp", lambda b: (a["sent_id"] == b["sent_id"]) & (a["start_w"] < b["end_w"]) & (b["start_w"] < a["end_w"])))
    category = F.when(F.col("distance") > 0, 0).when(overlap, 2).otherwise(1)
    if {"hp", "tp"} <= set(pairs.columns):
        near = pair_distance(pairs, ments, "hp", "tp").filter("cap_bucket <= 2").withColumn("category", category)
    else:
        near = pair_distance(pairs, ments).join(edge_category(ments), PAIR, "left").fillna(0, ["category"])
    near = (near.filter((F.col("category") > 0) | (F.col("cap_bucket") <= 2))
            .select("doc", ent("h").alias("src"), ent("t").alias("dst"), "category", F.col("cap_bucket").alias("bucket")))
    loops = (ments.select("doc", ent("entity").alias("src")).distinct()
             .unionByName(sents.select("doc", sen("sent_id").alias("src")))
             .select("doc", "src", F.col("src").alias("dst"), F.lit(4).alias("category"), F.lit(0).alias("bucket")))
    member = ments.select("doc", ent("entity").alias("src"), sen("sent_id").alias("dst")).distinct() \
        .withColumn("category", F.lit(3)).withColumn("bucket", F.lit(0))
    back = member.select("doc", F.col("dst").alias("src"), F.col("src").alias("dst"), "category", "bucket")
    return near.unionByName(loops).unionByName(member).unionByName(back)


def hetero_graph(ments: DataFrame, sents: DataFrame) -> DataFrame:
    """Typed mention / entity / sentence edges, both directions, no self loops."""
    node = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *cols)
    men, ent, sen = node("M", "entity", "mention"), node("E", "entity"), node("S", "sent_id")

    def edges(df, src, dst, kind):
        return df.select("doc", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))

    both = edges(ments, men, ent, "ME").unionByName(edges(ments, men, sen, "MS")).unionByName(
        edges(ments.select("doc", "entity", "sent_id").distinct(), ent, sen, "ES"))
    after = (sents.select("doc", "sent_id").withColumn("next", F.col("sent_id") + 1)
             .join(sents.select("doc", F.col("sent_id").alias("next")), ["doc", "next"]))
    both = both.unionByName(edges(after, sen, node("S", "next"), "SS"))
    other = ments.select("doc", F.col("entity").alias("e2"), F.col("mention").alias("m2"), F.col("sent_id").alias("s2"))
    differ = (F.col("entity") != F.col("e2")) | (F.col("mention") != F.col("m2"))
    peer = node("M", "e2", "m2")
    coref = edges(ments.join(other.withColumn("entity", F.col("e2")), ["doc", "entity"]).filter(differ), men, peer, "MM_COREF")
    cooc = edges(ments.join(other.withColumn("sent_id", F.col("s2")), ["doc", "sent_id"]).filter(differ), men, peer, "MM_COOC")
    return (both.unionByName(both.select("doc", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))
            .unionByName(coref).unionByName(cooc))


def pair_graph(pairs: DataFrame, directed: bool = False) -> DataFrame:
    """Edges between the entity pairs of a document: same head, same tail, bridge.

    ``directed`` splits the bridge into ``succ`` (the neighbour continues the chain) and ``pred``.
    """
    a = pairs.select("doc", F.col("h").alias("h1"), F.col("t").alias("t1"))
    b = pairs.select("doc", F.col("h").alias("h2"), F.col("t").alias("t2"))
    differ = "NOT (h1 = h2 AND t1 = t2)"

    def on(left: str, right: str, kind: str) -> DataFrame:
        keyed_a, keyed_b = a.withColumn("k", F.col(left)), b.withColumn("k", F.col(right))
        return (keyed_a.join(keyed_b, ["doc", "k"]).filter(differ)
                .select("doc", "h1", "t1", "h2", "t2", F.lit(kind).alias("edge_type")))

    same = on("h1", "h2", "same_head").unionByName(on("t1", "t2", "same_tail"))
    if directed:
        return same.unionByName(on("t1", "h2", "succ")).unionByName(on("h1", "t2", "pred"))
    bridge = on("t1", "h2", "bridge").unionByName(on("h1", "t2", "bridge")).distinct()
    return same.unionByName(bridge)


def candidate_neighbour_sums(ments: DataFrame, valued: DataFrame, values: list[str]) -> DataFrame:
    """``pair_neighbour_sums`` where the pairs are all candidate pairs of a document and ``valued`` (doc, h, t, *values) holds those with values, whole numbers.

    How many neighbours a pair has follows from the number of entities; an end's sums are added up in the document's row, so no pair is shuffled.
    """
    known = valued.filter("h <> t").groupBy("doc", "h", "t").agg(*[F.sum(F.coalesce(v, F.lit(0))).cast("bigint").alias(v) for v in values])
    known = known.groupBy("doc").agg(F.collect_list(F.struct("h", "t", *values)).alias("facts"))
    add = lambda found, v: F.aggregate(found, F.lit(0).cast("bigint"), lambda s, f: s + f[v])
    docs = doc_entities(ments).join(known, "doc", "left").withColumn("facts", F.coalesce("facts", F.array())).withColumn("ids", F.col("es.entity"))
    docs = docs.withColumn("facts", F.filter("facts", lambda f: F.array_contains("ids", f["h"]) & F.array_contains("ids", f["t"])))

    field = lambda name: lambda f: f[name]

    def end(e: Column) -> Column:
        out, into = F.filter("facts", lambda f: f["h"] == e["entity"]), F.filter("facts", lambda f: f["t"] == e["entity"])
        return F.struct(e["entity"].alias("entity"), *[F.transform(out, field(c)).alias(f"to_{c}") for c in ("t", *values)],
                        *[c for v in values for c in (add(out, v).alias(f"head_{v}"), add(into, v).alias(f"tail_{v}"))])

    # outer, as Spark filters by what an inner explode takes and would make it twice, each time from facts filtered anew; an entity is never null
    heads = docs.select("doc", F.transform("es", end).alias("es")).select("doc", F.size("es").cast("bigint").alias("m"), "es", F.explode_outer("es").alias("a"))
    # a pair's own value stands beside its head's others: looked up, as it is for each of all pairs, without a lambda
    share = lambda first, second, v: F.coalesce(found(f"{first}.to_t", F.col(f"{second}.entity"), f"{first}.to_{v}"), F.lit(0).cast("bigint"))
    pairs = heads.select("doc", "m", "a", F.explode_outer("es").alias("b")).filter("a.entity <> b.entity").select(
        "doc", "m", F.col("a.entity").alias("h"), F.col("b.entity").alias("t"),
        *[c for v in values for c in (F.col(f"a.head_{v}").alias(f"a_head_{v}"), F.col(f"a.tail_{v}").alias(f"a_tail_{v}"), F.col(f"b.head_{v}").alias(f"b_head_{v}"),
                                      F.col(f"b.tail_{v}").alias(f"b_tail_{v}"), share("a", "b", v).alias(f"own_{v}"), share("b", "a", v).alias(f"back_{v}"))])
    counts = {"same_head": F.col("m") - 2, "same_tail": F.col("m") - 2, "succ": F.col("m") - 1, "pred": F.col("m") - 1, "bridge": 2 * F.col("m") - 3}
    of = lambda name: lambda v: F.col(f"{name}_{v}")
    sums = {"same_head": lambda v: of("a_head")(v) - of("own")(v), "same_tail": lambda v: of("b_tail")(v) - of("own")(v), "succ": of("b_head"), "pred": of("a_tail"),
            "bridge": lambda v: of("b_head")(v) + of("a_tail")(v) - of("back")(v)}
    return pairs.select("doc", "h", "t", *[c for k in counts for c in (counts[k].alias(f"{k}_n"), *[sums[k](v).alias(f"{k}_{v}") for v in values])])


def pair_neighbour_sums(pairs: DataFrame, values: list[str]) -> DataFrame:
    """What the pair graph adds up for each pair, without its edges: per edge type the number of neighbours and the sum of each of ``values`` over them.

    Columns ``<type>_n`` and ``<type>_<value>`` for same_head, same_tail, succ, pred and bridge. ``pairs``: distinct (doc, h, t, *values) with h <> t. Pairs that share an
    end share its sums, so the list of pairs of pairs is never made: a pair's own share is taken from its ends' sums, and the reverse pair, which
    follows and precedes at once, from the bridge's.
    """
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = pairs.select("doc", "h", "t", *[F.coalesce(v, F.lit(0)).alias(v) for v in values]).withColumn("n", F.lit(1).cast("bigint"))
    sums = ["n", *values]

    def end(column: str, name: str) -> DataFrame:
        return own.groupBy("doc", F.col(column).alias("e")).agg(*[F.sum(v).alias(f"{name}_{v}") for v in sums])

    ends = stored(end("h", "as_head").join(end("t", "as_tail"), ["doc", "e"], "full_outer"), "ends")
    at = lambda column: ends.select("doc", F.col("e").alias(column), *[F.col(f"{k}_{v}").alias(f"{column}_{k}_{v}") for k in ("as_head", "as_tail") for v in sums])
    back = own.select("doc", F.col("h").alias("t"), F.col("t").alias("h"), *[F.col(v).alias(f"back_{v}") for v in sums])
    joined = own.join(at("h"), ["doc", "h"]).join(at("t"), ["doc", "t"]).join(back, ["doc", "h", "t"], "left")
    kinds = {"same_head": lambda v: of(f"h_as_head_{v}") - of(v), "same_tail": lambda v: of(f"t_as_tail_{v}") - of(v),
             "succ": lambda v: of(f"t_as_head_{v}"), "pred": lambda v: of(f"h_as_tail_{v}"),
             "bridge": lambda v: of(f"t_as_head_{v}") + of(f"h_as_tail_{v}") - of(f"back_{v}")}
    return joined.select("doc", "h", "t", *[kind(v).alias(f"{name}_{v}") for name, kind in kinds.items() for v in sums])


def sub_document(keep: DataFrame, ments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Restrict documents to the (doc, sent_id) rows of ``keep``: sentence map, entity map, re-indexed mentions."""
    kept = keep.select("doc", "sent_id").distinct()
    sent_map = running_total(kept, ["doc"], "sent_id", F.lit(1), "new_sent_id")
    inside = ments.join(sent_map, ["doc", "sent_id"])
    entity_map = running_total(inside.select("doc", "entity").distinct(), ["doc"], "entity", F.lit(1), "new_entity")
    moved = inside.join(entity_map, ["doc", "entity"]).select(
        "doc", F.col("new_entity").alias("entity"), "mention", "name", F.col("new_sent_id").alias("sent_id"),
        "start_w", "end_w", "type")
    return sent_map, entity_map, moved


def overlap_windows(df: DataFrame, size: int, length: str = "n_tokens") -> DataFrame:
    """Windows of ``size`` positions that cover every position: side by side, the last one moved back to end with the text.

    A text of up to two sizes has at most two windows, its first and its last ``size`` positions; one of up to ``size`` has one.
    """
    n = F.col(length).cast("int")
    last = F.greatest(n - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size)), F.array(last)))
    spans = F.transform(starts, lambda a, i: F.struct(i.cast("int").alias("window"), a.cast("int").alias("start"),
                                                      F.least(a + size, n).cast("int").alias("end")))
    return df.select("*", F.inline(spans))


def stitch_windows(values: DataFrame, keys: list[str]) -> DataFrame:
    """Average of the window outputs at each position: (keys, position, value)."""
    return values.groupBy(*keys, "position").agg(F.avg("value").alias("value"), F.count("*").alias("n_windows"))


def span_mass(weights: DataFrame, spans: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """Adds ``mass`` to every span: the sum of ``weight`` over the tokens whose ``position`` lies in [start, end).

    A range join: tokens and spans meet on equal keys and position block, the range test runs as the join's residual,
    and masses add up map-side. Blocks also spread a long document over tasks.
    """
    place = [*keys, "_block"]
    tokens = weights.select(*keys, "position", "weight", F.floor(F.col("position") / block).alias("_block"))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    pieces = spans.select(*keys, "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor(last / block))).alias("_block")).distinct()
    summed = (pieces.join(tokens, place).filter("position >= start AND position < `end`")
              .groupBy(*keys, "start", "end").agg(F.sum("weight").alias("mass")))
    return spans.join(summed, [*keys, "start", "end"], "left").fillna(0.0, ["mass"])


def sample_docs(df: DataFrame, n: int, seed: int, key: str = "doc") -> DataFrame:
    """``n`` documents by a seeded hash order: reproducible, and a top-n rather than a sort of everything."""
    return df.orderBy(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
