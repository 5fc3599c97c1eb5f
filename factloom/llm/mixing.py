"""Op 6. Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source form blocks, and blocks fall into frames: of a source of weight w, frame k of F slots takes round((k + 1) w F) - round(k w F)
blocks, so what rounding leaves over is carried and never adds up. At a frame's end a source is within (1 + w n) / 2 blocks of its weight, n being the
number of sources, at any number of rows. In a frame, slot by slot, the released block of the earliest deadline is taken (Pfair), which keeps every
source less than one block from its even share of the frame. When a source runs out, the frames after that are shorter and leave the
others in proportion to their weights; no document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import stored

BLOCK_DOCS, FRAME = 16, 128
SMALL = 200_000  # rows of (source, number, number, number): at most some ten MB are broadcast


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint only where the table proves small; else a plain join, which AQE splits where it is skewed."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, source, n (0, 1, ... within the source, by doc_id): ranges of (source, doc_id), whose totals are carried over."""
    ranged = stored(docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
                    .withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    first = ranged.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each source and range
    carried = first.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    return ranged.join(_bounded(stored(carried, "carried")), ["source", "part"]).select("doc_id", "source", (F.col("at") - F.col("first") + F.col("before")).alias("n"))


def _frame(quota: Column) -> Column:
    """The source (by place in ``quota``) of each slot of a frame in which source i has quota[i] blocks: earliest deadline first among the released."""
    length = F.aggregate(quota, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    state = F.struct(F.transform(quota, lambda x: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<int>").alias("out"))

    def slot(acc: Column, t: Column) -> Column:
        # released: done / quota * length <= t; deadline: ceil((done + 1) * length / quota), in whole numbers
        ready = F.filter(F.transform(F.arrays_zip(quota.alias("q"), acc["done"].alias("d")), lambda z, i: F.struct(
            F.when((z["d"] < z["q"]) & (z["d"] * length < (t + 1) * z["q"]), F.floor(((z["d"] + 1) * length + z["q"] - 1) / z["q"])).alias("deadline"), i.alias("i"))),
            lambda z: z["deadline"].isNotNull())
        chosen = F.array_min(ready)["i"]
        return F.struct(F.transform(acc["done"], lambda d, i: d + F.when(i == chosen, 1).otherwise(0)).alias("done"),
                        F.concat(acc["out"], F.array(chosen)).alias("out"))

    return F.when(length > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), length - 1), state, slot, lambda acc: acc["out"]))


def schedule(df: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, frame: int | None = None,
             id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, block, slot, place: every document's block within its source, the block's slot, and the document's place in the mixed order.

    ``weights``: target weight by source; sources not named get the mean weight. None: the square root of a source's documents. Weights are
    kept as they are; only where ``frame`` is given are they rounded to whole blocks of a frame of about so many slots, one at least. A null source is a source of its own. Rows repeated under one id and source share one place. An empty table
    gives no row. The driver gets no row; tables with a row for each source, or each slot of each kind of frame, are broadcast only if small.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("given"))
    docs = docs.groupBy("doc_id", "given").count().select("doc_id", "given", F.coalesce(F.concat(F.lit("="), "given"), F.lit("null")).alias("source"))
    numbered = stored(_numbered(docs.select("doc_id", "source")), "numbered")
    sources = numbered.groupBy("source").agg(F.ceil(F.count("*") / block_docs).cast("bigint").alias("blocks"), F.count("*").alias("docs"))
    if weights:
        mean = sum(weights.values()) / len(weights)
        named = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(f"={k}"), F.lit(float(v)))])
        sources = sources.withColumn("weight", F.coalesce(F.try_element_at(named, F.col("source")), F.lit(mean)))
    else:
        sources = sources.withColumn("weight", F.sqrt("docs"))
    total = sources.agg(F.sum("weight").alias("total"))
    each = sources.crossJoin(F.broadcast(total)).withColumn("pace", F.col("weight") / F.col("total") * (frame or FRAME))  # blocks in a frame
    if frame:
        each = each.withColumn("pace", F.greatest(F.lit(1.0), F.round("pace")))
    each = stored(each.select("source", "blocks", "pace"), "sources")

    def before(k: Column) -> Column:
        """Blocks of a source in the frames before frame k: what is left over in one frame is carried to the next."""
        return F.least(F.col("blocks"), F.floor(F.col("pace") * k + 0.5))

    k = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("block") + 0.5) / F.col("pace")) - 1)
    dealt = numbered.join(_bounded(each), "source").withColumn("block", F.floor(F.col("n") / block_docs)).withColumn("k", k)
    # where rounding of the quotient and of the product differ
    dealt = dealt.withColumn("k", F.when(F.col("block") < before(F.col("k")), F.col("k") - 1).when(F.col("block") >= before(F.col("k") + 1), F.col("k") + 1).otherwise(F.col("k")))
    dealt = dealt.withColumn("j", F.col("block") - before(F.col("k"))).select("doc_id", "source", "n", "block", "k", "j")
    quotas = dealt.groupBy("k", "source").agg((F.max("j") + 1).alias("q"))  # at most a row for each block
    frames = stored(quotas.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("s"))
                    .withColumn("quota", F.transform("s", lambda x: x["q"])), "frames")
    starts = frames.select("k").crossJoin(F.broadcast(each)).groupBy("k").agg(F.sum(before(F.col("k"))).cast("bigint").alias("start"))
    slots = frames.repartition("k").withColumn("order", _frame(F.col("quota"))).select(
        "k", F.posexplode(F.transform("order", lambda i: F.element_at("s", i + 1)["source"])).alias("offset", "source"))
    within = W.partitionBy("k", "source").orderBy("offset")  # at most a frame
    slots = slots.withColumn("j", F.row_number().over(within).cast("bigint") - 1).join(starts, "k").select("k", "source", "j", (F.col("start") + F.col("offset")).alias("slot"))
    placed = dealt.join(_bounded(stored(slots, "slots")), ["k", "source", "j"])
    name = F.when(F.col("source") != "null", F.substring("source", 2, 2 ** 31 - 1))
    return placed.select("doc_id", name.alias("source"), "block", "slot", (F.col("slot") * block_docs + F.col("n") % block_docs).alias("place"))


def file_order() -> Column:
    """A row's place in the files that ``mix`` was written to, as one rising number: Spark numbers a table's files by partition, but deals them to tasks by size."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    return F.shiftleft(part, 40) + F.col("_metadata.row_index")


def mix(df: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, frame: int | None = None,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` in mixed order: ranges of places, each sorted, so files written from it read in that order. All columns and rows stay."""
    placed = schedule(df, weights, block_docs, frame, id_col, source_col).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("place").alias("_place"))
    rows = df.join(placed, df[id_col].cast("bigint").eqNullSafe(placed["_id"]) & df[source_col].cast("string").eqNullSafe(placed["_source"]), "left")
    return rows.repartitionByRange("_place").sortWithinPartitions("_place", id_col).select(*[df[c] for c in df.columns])
