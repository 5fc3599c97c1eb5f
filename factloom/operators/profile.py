"""Corpus profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.docmodel import PAIR, with_pair_sents


def doc_stats(docs: DataFrame) -> DataFrame:
    """Sentences, tokens, entities, mentions and labels per nested document."""
    total = lambda c: F.aggregate(F.transform(c, F.size), F.lit(0), lambda s, n: s + n)
    return docs.select(*[c for c in ("doc", "split") if c in docs.columns],
                       F.size("sents").alias("n_sents"), total("sents").alias("n_tokens"), F.size("vertexSet").alias("n_entities"),
                       total("vertexSet").alias("n_mentions"), F.coalesce(F.size(F.coalesce("labels", F.array())), F.lit(0)).alias("n_labels"))


STATS = ("n_sents", "n_tokens", "n_entities", "n_mentions", "n_labels")


def split_summary(stats: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each count per split."""
    return stats.groupBy("split").agg(F.count("*").alias("n_docs"), *[a for c in STATS for a in (
        F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"))])


def entity_type_counts(ments: DataFrame) -> DataFrame:
    return ments.groupBy("type").agg(F.count("*").alias("n"))


def relation_counts(labs: DataFrame, relations: DataFrame, n: int | None = None) -> DataFrame:
    """Labels per relation with its name, most frequent first, optionally the top ``n``."""
    from factloom.operators.graph import with_relation_name
    out = with_relation_name(labs.groupBy("r").agg(F.count("*").alias("n")), relations).orderBy(F.desc("n"), "r")
    return out.limit(n) if n else out


def locality_counts(labs: DataFrame, ments: DataFrame) -> DataFrame:
    """Labels whose ends share a sentence, the others, and the share of the first."""
    rows = with_pair_sents(labs, ments).select(F.arrays_overlap("hs", "ts").alias("intra"))
    out = rows.agg(F.count_if("intra").alias("intra"), F.count_if(~F.col("intra")).alias("inter"))
    return out.withColumn("intra_share", F.when(F.col("intra") + F.col("inter") > 0, F.col("intra") / (F.col("intra") + F.col("inter"))).otherwise(0.0))


def evidence_length_stats(labs: DataFrame) -> DataFrame:
    """Mean, median and maximum number of evidence sentences; the median reads the counts per length."""
    lengths = labs.groupBy(F.size("evidence").cast("double").alias("length")).agg(F.count("*").alias("n"))
    return lengths.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean"),
                       F.percentile("length", F.lit(0.5), F.col("n")).alias("median"), F.max("length").cast("int").alias("longest"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the right edge belongs to the last bin."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    width = (high - low) / bins
    index = F.when(width > 0, F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def na_ratio(pairs: DataFrame, labs: DataFrame) -> DataFrame:
    """Share of entity pairs without any relation; pairs of ``candidate_facts`` know theirs, others are joined."""
    if "facts" in pairs.columns:
        return pairs.agg(F.count("*").alias("n_pairs"), F.avg(F.when(F.size("facts") == 0, 1.0).otherwise(0.0)).alias("na_share"))
    labelled = labs.select(*PAIR).distinct().withColumn("labelled", F.lit(1))
    return pairs.join(labelled, PAIR, "left").agg(
        F.count("*").alias("n_pairs"), F.avg(F.when(F.col("labelled").isNull(), 1.0).otherwise(0.0)).alias("na_share"))


def overlong_share(sized: DataFrame, limit: int, length: str = "n_tokens") -> DataFrame:
    return sized.agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col(length) > limit, 1.0).otherwise(0.0)).alias("overlong_share"))


def split_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("split").agg(F.count("*").alias("n_docs"))
