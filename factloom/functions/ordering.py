"""Global positions and running totals without a single-task window.

A window without PARTITION BY, or partitioned by a key that may hold a third of all rows, runs in one task. Both
helpers split the order into blocks, aggregate per block, and carry the block totals over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import PLACED, checkpointed

BLOCK = 4096


def _before(window: W, column: Column) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                  block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the rows before this one, per ``keys``, by the integer column ``order``.

    Rows that lie by one of the keys already are in its task with all their blocks, so one window adds them up and ``df`` is not read again for the totals.
    """
    if any(df.schema[k].metadata.get(PLACED) for k in keys):
        return df.withColumn(name, _before(W.partitionBy(*keys).orderBy(order), value).cast("bigint"))
    blocked = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    carry = totals.select(
        *keys, "_block",
        _before(W.partitionBy(*keys).orderBy("_block"), F.col("_total")).alias("_carry"))
    local = _before(W.partitionBy(*keys, "_block").orderBy(order), F.col("_value"))
    return (blocked.withColumn("_local", local)
            .join(carry, [*keys, "_block"])
            .withColumn(name, (F.col("_local") + F.col("_carry")).cast("bigint"))
            .drop("_block", "_value", "_local", "_carry"))


def prefix_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Adds ``before_<v>`` for every value column: the total over all rows with a smaller (unique) ``order``."""
    ranged = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per partition, so this window is bounded by the partition count
    carry = totals.select("_part", *[
        _before(W.orderBy("_part"), F.col(f"_t_{v}")).alias(f"_c_{v}") for v in values])
    local = W.partitionBy("_part").orderBy(order)
    out = ranged.select("*", *[_before(local, F.col(v)).alias(f"_l_{v}") for v in values]).join(carry, "_part")
    return out.select(*df.columns, *[
        (F.col(f"_l_{v}") + F.col(f"_c_{v}")).alias(f"before_{v}") for v in values])


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Zero-based global position by the total order ``order``: one range shuffle plus per-partition offsets."""
    ranged = checkpointed(
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
        .withColumn("_row", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", _before(W.orderBy("_part"), F.col("_n")).alias("_offset"))
    return (ranged.join(offsets, "_part")
            .withColumn(name, F.col("_offset") + F.col("_row"))
            .drop("_mono", "_part", "_row", "_offset"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group by a total order; Spark limits each group map-side before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
