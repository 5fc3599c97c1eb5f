"""Connected components of a graph of pairs, by rounds of large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of ``edges`` (a, b).

    A round links the larger neighbours of each node to the smallest node next to it, then the smaller ones; rows never become more than the edges. A
    node with very many neighbours costs one row each and a minimum that is summed up before the shuffle, not a gathered list.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a")
        pairs = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                       .union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
