"""Entity linking: mentions of questions to graph entities.

``mentions``: (question_id, mention). ``entities``: (id, name, type) and, where aliases count, ``aliases``. Results:
(question_id, mention, id, name, type), at most k per mention by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.ordering import top_per_group
from factloom.functions.similarity import indel_ratio
from factloom.schemas import ENTITY_TYPES, FUZZY_CUTOFF, SEEDS_PER_MENTION
from factloom.session import checkpointed

MENTION = ["question_id", "mention"]
HIT = [*MENTION, "id", "name", "type"]
_WORD = "[a-z0-9_]"


def _asked(mentions: DataFrame) -> DataFrame:
    """Distinct mention strings: equal mentions of many questions are matched once."""
    return mentions.select("mention").distinct()


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all shuffle partitions: a few bytes of text are much work once their parts are exploded, and AQE would leave them to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _spread_pairs(pairs: DataFrame) -> DataFrame:
    """Different pairs, dealt over all shuffle partitions: two short texts are much work to compare, and AQE would leave millions of pairs to a few tasks."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mention", "name").distinct()


def _sharing(keys: DataFrame, index: DataFrame, *more: str) -> DataFrame:
    """Rows of both sides with equal ``key`` (and ``more``), never by broadcast: Spark takes an exploded side to be as small as the texts that it was made of, and would send it whole through the driver."""
    return keys.hint("merge").join(index, ["key", *more])


def _per_question(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    return mentions.select(*MENTION).join(matches, "mention").select(*HIT)


def _limited(matches: DataFrame, k: int) -> DataFrame:
    distinct = matches.select("mention", "id", "name", "type").dropDuplicates(["mention", "id"])
    return top_per_group(distinct, ["mention"], [F.asc("id")], k).drop("rank")


def link_exact(mentions: DataFrame, entities: DataFrame, k: int = SEEDS_PER_MENTION) -> DataFrame:
    keyed = _asked(mentions).withColumn("key", F.lower("mention"))
    found = keyed.join(entities.select("id", "name", "type", F.lower("name").alias("key")), "key")
    return _per_question(mentions, _limited(found, k))


def link_alias(mentions: DataFrame, entities: DataFrame, k: int = SEEDS_PER_MENTION) -> DataFrame:
    keyed = _asked(mentions).withColumn("key", F.lower("mention"))
    surfaces = entities.select("id", "name", "type", F.explode("aliases").alias("alias"))
    found = keyed.join(surfaces.withColumn("key", F.lower("alias")), "key")
    return _per_question(mentions, _limited(found, k))


def _surfaces(entities: DataFrame) -> DataFrame:
    """Names and, if present, aliases as (id, name, type, surface)."""
    if "aliases" not in entities.columns:
        return entities.select("id", "name", "type", F.col("name").alias("surface"))
    every = F.array_union(F.array("name"), F.coalesce("aliases", F.array("name")))
    return entities.select("id", "name", "type", F.explode(every).alias("surface"))


def _runs(text: Column) -> Column:
    """Maximal word runs and maximal runs of other characters, lower case."""
    low = F.lower(text)
    return F.filter(F.array_union(F.split(low, "[^a-z0-9_]+"), F.split(low, f"{_WORD}+")), lambda r: r != "")


def _rarest(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Per mention, the key that the fewest index rows carry: hot keys are joined only by mentions with no rarer one."""
    counts = index.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    return (keys.hint("merge").join(counts, "key", "left").groupBy("mention")
            .agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key")))


def boundary_pattern(mention: Column) -> Column:
    """``(?i).*\\b<mention>\\b.*`` spelled with explicit ASCII boundaries."""
    escaped = F.regexp_replace(mention, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    word = "[A-Za-z0-9_]"
    head = F.when(mention.rlike(f"^{word}"), f"(?<!{word})").otherwise(f"(?<={word})")
    tail = F.when(mention.rlike(f"{word}$"), f"(?!{word})").otherwise(f"(?={word})")
    return F.concat(F.lit("(?i)"), head, escaped, tail)


def link_word_boundary(mentions: DataFrame, entities: DataFrame, k: int = SEEDS_PER_MENTION) -> DataFrame:
    """Mention as whole words inside a name or alias, case-insensitive.

    Every word run of the mention is a whole word run of the name (a mention without word characters is a whole run of
    others), so an equi-join on the mention's rarest run is a lossless pre-filter and the pattern tests only its hits.
    """
    index = _surfaces(entities).select("*", F.explode(F.array_distinct(_runs(F.col("surface")))).alias("key"))
    asked = _asked(mentions).filter(F.char_length("mention") > 0)
    low = F.lower("mention")
    # every surface with the word of a one-word mention is a match, so the index is cut to k entities a word before it meets the mentions
    plain = F.col("mention").rlike("^[A-Za-z0-9_]+$")
    single = asked.filter(plain).select("mention", low.alias("key"))
    hits = index.join(single.select("key").distinct(), "key", "left_semi").filter(F.rlike("surface", boundary_pattern(F.col("key"))))
    best = top_per_group(hits.select("key", "id", "name", "type").dropDuplicates(["key", "id"]), ["key"], [F.asc("id")], k).drop("rank")
    of_one = single.join(best, "key").select("mention", "id", "name", "type")
    words = F.filter(F.split(low, "[^a-z0-9_]+"), lambda r: r != "")
    keys = asked.filter(~plain).select("mention", F.explode(F.array_distinct(
        F.when(F.size(words) > 0, words).otherwise(F.array(low)))).alias("key"))
    found = (_sharing(_rarest(keys, index), index)
             .filter(F.rlike("surface", boundary_pattern(F.col("mention")))))
    return _per_question(mentions, of_one.unionByName(_limited(found, k)))


def _grams(text: Column, n: int) -> Column:
    size = F.char_length(text)
    return F.when(size >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.expr("cast(array() AS array<string>)"))


def link_substring(mentions: DataFrame, entities: DataFrame, k: int = SEEDS_PER_MENTION) -> DataFrame:
    """Mention anywhere inside a name or alias, case-insensitive (the baseline's linker).

    Joined on the mention's rarest trigram (the whole mention when shorter), which every match contains.
    """
    asked = _asked(mentions).filter(F.char_length("mention") > 0).withColumn("low", F.lower("mention"))
    surfaces = _surfaces(entities).withColumn("low_surface", F.lower("surface"))
    found = None
    for n in (1, 2, 3):
        mine = asked.filter(F.char_length("low") >= 3 if n == 3 else F.char_length("low") == n)
        index = surfaces.select("*", F.explode(_grams(F.col("low_surface"), n)).alias("key"))
        keys = mine.select("mention", F.explode(_grams(F.col("low"), n)).alias("key"))
        part = (_sharing(_rarest(keys, index), index)
                .filter(F.contains("low_surface", F.lower("mention"))).select("mention", "id", "name", "type"))
        found = part if found is None else found.unionByName(part)
    return _per_question(mentions, _limited(found, k))


def _numbered_grams(text: Column) -> Column:
    """Bigrams of the padded text, the i-th occurrence of a bigram numbered i."""
    padded = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def _prefix_pairs(mentions: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(mention, name) that may reach ``cutoff``: with s = cutoff/200, a match has LCS >= s(la+lb) =: L, so 3L - la - lb + 1 of the padded, numbered
    bigrams are common: a deletion breaks at most two of the mention's bigrams, an insertion one. Leaving out a mention's commonest bigrams, as many
    as that bound spares at every admissible length, still leaves a shared one, so the join never touches them; the count of shared bigrams then drops
    most of the rest. Below a cutoff of 200/3 the bound spares none."""
    share = cutoff / 200.0
    floor_len = share / (1 - share)  # shortest admissible lb / la
    asked = mentions.select("mention", F.char_length("mention").alias("la")).distinct()
    keys = _spread(asked).select("mention", "la", F.explode(_numbered_grams(F.col("mention"))).alias("key"))
    pool = names.select("name").distinct().withColumn("lb", F.char_length("name"))
    index = _spread(pool).select("name", "lb", F.explode(_numbered_grams(F.col("name"))).alias("key"))
    counts = index.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # the bound is smallest at the shortest admissible name: (3s-1)(la+lb)+1 common bigrams
    spare = F.floor((3 * share - 1) * (1 + floor_len) * F.col("la") + 1e-9)
    rank = F.row_number().over(W.partitionBy("mention").orderBy(F.coalesce("n", F.lit(0)), "key"))
    prefix = (keys.hint("merge").join(counts, "key", "left").withColumn("rank", rank)
              .withColumn("spare", spare).filter(F.col("rank") <= F.col("la") + 1 - F.col("spare")))
    longest = lambda lb: F.ceil(share * (F.col("la") + lb) - 1e-9)
    need = 3 * longest(F.col("lb")) - F.col("la") - F.col("lb") + 1 - F.col("spare")
    # a mention's keys meet only names of a length that it can match: short mentions share bigrams with all long names
    fitting = F.filter(_lengths(names), lambda lb: (longest(lb) <= F.col("la")) & (longest(lb) <= lb))
    prefix = prefix.select("mention", "la", "spare", "key", F.explode(fitting).alias("lb"))
    shared = (_sharing(prefix, index, "lb").groupBy("mention", "name", "la", "lb", "spare")
              .agg(F.count("*").alias("shared")).filter(F.col("shared") >= need))
    return shared.select("mention", "name")


def _lengths(names: DataFrame) -> Column:
    """The different lengths of the names, a few hundred numbers at most, as a constant array."""
    found = sorted(r[0] for r in names.select(F.char_length("name")).distinct().dropna().collect())
    return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")


def _length_pairs(mentions: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(mention, name) whose lengths admit ``cutoff``: 2 min(la, lb) >= cutoff/100 (la + lb). An equi-join on the length, for cutoffs that no index serves."""
    share = cutoff / 200.0
    pool = names.select("name").distinct().withColumn("lb", F.char_length("name"))
    asked = mentions.select("mention", F.char_length("mention").alias("la")).distinct()
    fits = F.filter(_lengths(names), lambda lb: F.least(F.col("la"), lb) >= share * (F.col("la") + lb) - 1e-9)
    return asked.select("mention", F.explode(fits).alias("lb")).join(pool, "lb").select("mention", "name")


def fuzzy_pairs(mentions: DataFrame, names: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """All (mention, name, ratio) with an Indel ratio of at least ``cutoff`` (in percent): a bigram index down to 200/3, pairs of fitting lengths below."""
    pairs = _prefix_pairs(mentions, names, cutoff) if cutoff >= 200 / 3 else _length_pairs(mentions, names, cutoff)
    return pairs.select("mention", "name", indel_ratio(F.col("mention"), F.col("name")).alias("ratio")).filter(F.col("ratio") >= cutoff)


# texts of at most so many letters are also found by what is left of them when letters are struck out
STRUCK_LENGTH, STRUCK_LETTERS = 40, 2


def _struck(text: Column, letters: int) -> Column:
    """Hashes of all that is left of a text when 0 to ``letters`` letters are struck out."""
    def less(one: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(one)), lambda i: F.concat(F.substring(one, F.lit(1), i - 1), F.substring(one, i + 1, F.char_length(one))))

    layers = [F.array(text)]
    for _ in range(letters):
        longer = F.filter(layers[-1], lambda one: one != "")
        layers.append(F.array_distinct(F.flatten(F.transform(longer, less))))
    return F.array_distinct(F.transform(F.concat(*layers), lambda one: F.xxhash64(one)))


def struck_pairs(mentions: DataFrame, names: DataFrame, letters: int) -> DataFrame:
    """(mention, name, ratio) of all pairs that are equal when at most ``letters`` letters are struck out of each, both of at most ``STRUCK_LENGTH`` (names: and ``letters`` more).

    The join meets on what is left, so pairs that share most of their text without being close never meet; a pair meets once for each way to strike.
    """
    asked = mentions.select("mention").distinct().filter(F.char_length("mention") <= STRUCK_LENGTH)
    pool = names.select("name").distinct().filter(F.char_length("name") <= STRUCK_LENGTH + letters)
    keys = _spread(asked).select("mention", F.explode(_struck(F.col("mention"), letters)).alias("key"))
    index = _spread(pool).select("name", F.explode(_struck(F.col("name"), letters)).alias("key"))
    pairs = _spread_pairs(_sharing(keys, index).select("mention", "name"))
    return pairs.select("mention", "name", indel_ratio(F.col("mention"), F.col("name")).alias("ratio"))


def _unseen(names: DataFrame, mentions: DataFrame, letters: int) -> DataFrame:
    """(mention, bound): the highest ratio of a name that ``struck_pairs`` may have missed, from the lengths that names have."""
    la = F.col("la")

    def highest(lb: Column) -> Column:
        # a missed name needs more letters struck on one side at least
        common = F.greatest(F.least(lb, la - letters - 1), F.least(la, lb - letters - 1), F.lit(0))
        common = F.when(la > STRUCK_LENGTH, F.least(la, lb)).otherwise(common)
        return F.when(la + lb > 0, 200.0 * common / (la + lb)).otherwise(0.0)

    bound = F.coalesce(F.array_max(F.transform(_lengths(names), highest)), F.lit(0.0))
    return mentions.select("mention", F.char_length("mention").alias("la")).distinct().select("mention", bound.alias("bound"))


def link_fuzzy(mentions: DataFrame, entities: DataFrame, cutoff: float = FUZZY_CUTOFF,
               k: int = SEEDS_PER_MENTION) -> DataFrame:
    """Best k entity names by Indel ratio (case-sensitive), ties by id. Adds ``ratio``.

    Close names are found by striking out 0, 1, then 2 letters. A mention is done when its k-th match beats the highest ratio of any name that may have
    been missed, which the lengths of the names bound; only the others go on, in the end to all pairs that may reach ``cutoff``. The result is the top k of
    the full comparison.
    """
    rest, out = _asked(mentions), None
    ids = entities.select("id", "name", "type")

    def best_of(pairs: DataFrame) -> DataFrame:
        return checkpointed(top_per_group(pairs.filter(F.col("ratio") >= cutoff).join(ids, "name"), ["mention"], [F.desc("ratio"), F.asc("id")], k).drop("rank"))

    for letters in range(STRUCK_LETTERS + 1):
        best = best_of(struck_pairs(rest, ids, letters))
        full = (best.groupBy("mention").agg(F.count("*").alias("n"), F.min("ratio").alias("last")).filter(F.col("n") >= k)
                .join(_unseen(ids, rest, letters), "mention").filter(F.col("last") > F.col("bound") + 1e-9).select("mention"))
        full = checkpointed(full)
        best, rest = best.join(full, "mention", "left_semi"), checkpointed(rest.join(full, "mention", "left_anti"))
        out = best if out is None else out.unionByName(best)
    out = out.unionByName(best_of(fuzzy_pairs(rest, ids.select("name"), cutoff)))
    return mentions.select(*MENTION).join(out, "mention").select(*HIT, "ratio")


STAGES = (("exact", link_exact), ("alias", link_alias), ("word_boundary", link_word_boundary), ("fuzzy", link_fuzzy))


def link(mentions: DataFrame, entities: DataFrame, k: int = SEEDS_PER_MENTION) -> DataFrame:
    """First stage with any hit wins, per mention; adds ``stage``. Each stage sees only what the earlier ones left.

    Stage results hold at most k rows per mention and are checkpointed, so a later stage does not recompute them.
    """
    rest, out = mentions.select(*MENTION).distinct(), None
    for stage, matcher in STAGES:
        if stage == "alias" and "aliases" not in entities.columns:
            continue
        hits = checkpointed(matcher(rest, entities, k=k).select(*HIT, F.lit(stage).alias("stage")))
        rest = rest.join(hits.select(*MENTION).distinct(), MENTION, "left_anti")
        out = hits if out is None else out.unionByName(hits)
    return out


def apply_type_hint(links: DataFrame, hints: DataFrame) -> DataFrame:
    """Keep the hinted type where any candidate of the mention has it, else keep all. ``hints``: (question_id, mention, hint)."""
    hinted = links.join(hints, MENTION, "left").withColumn("fits", F.coalesce(F.col("type") == F.col("hint"), F.lit(False)))
    any_fit = F.max("fits").over(W.partitionBy(*MENTION))
    return hinted.withColumn("any_fit", any_fit).filter("fits OR NOT any_fit").drop("fits", "any_fit", "hint")


def validate_queries(questions: DataFrame, relations: DataFrame) -> DataFrame:
    """Parsed questions with unknown relation and entity types nulled, and hints nulled when their number is wrong.

    ``relations``: (relation_type) whitelist.
    """
    known = relations.select("relation_type").distinct().withColumn("_known", F.lit(True))
    types = F.array(*[F.lit(x) for x in ENTITY_TYPES])
    right = F.size("entities") == F.size("entity_hints")
    nothing = F.transform("entities", lambda e: F.lit(None).cast("string"))
    hints = F.when(right, F.transform("entity_hints", lambda h: F.when(F.array_contains(types, h), h))).otherwise(nothing)
    return (questions.join(known, "relation_type", "left")
            .withColumn("relation_type", F.when(F.col("_known"), F.col("relation_type")))
            .withColumn("entity_hints", hints)
            .withColumn("value", F.when(F.col("value") != "", F.col("value")))
            .withColumn("entity_type", F.when(F.array_contains(types, F.col("entity_type")), F.col("entity_type")))
            .drop("_known"))
