"""Session defaults and lineage control."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "factloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    AQE coalesces shuffle partitions, splits skewed join partitions and turns shuffle joins into broadcast joins
    when a side proves small at run time, so no operator hints a broadcast of growing data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # collect_list and max_by keep this many groups in a task before they sort; the default of 128 sorts at once
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names, or one beside the warehouse in local mode.

    A folder of one machine is of no use to other machines, so a cluster that names none gets an error.
    """
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if not chosen.isDefined():
        named = spark.conf.get(CHECKPOINT_CONF, None)
        if not named and not re.fullmatch(r"local(\[[^,]*\])?", context.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
        chosen = context._jsc.sc().getCheckpointDir()
    return chosen.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage is cut, and each row was computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

# Spark estimates rows made by ``explode`` to be no larger than what they were made of, and without a shuffle AQE learns nothing better. A document's row becomes some hundred
# times its bytes in pairs, so while buckets are read files count for as much more as keeps such sides from being broadcast through the driver.
FILE_FACTOR, UNFOLDED = "spark.sql.sources.fileCompressionFactor", "1000"


def reading_buckets(spark: SparkSession, on: bool) -> None:
    """Whether plans made from now on read documents in buckets: joins on more columns than the buckets' key stay in place, and nothing unfolded is broadcast."""
    spark.conf.set(CO_PARTITION, "false" if on else "true")
    spark.conf.set(FILE_FACTOR, UNFOLDED if on else "1.0")


PLACED = "bucketed"


def placed_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key``, as it is where it is read from buckets by ``key``."""
    return df if df.schema[key].metadata.get(PLACED) else df.repartition(key)


def stored_by(df: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """As ``stored``, but in ``buckets`` by the hash of ``key``: what is grouped or joined by ``key``, or by it and more columns, stays in its task.

    Spark shuffles a join on more columns unless told that the key's buckets do.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    df = df.withMetadata(key, {PLACED: True})
    df.write.bucketBy(buckets, key).option("path", shared_folder(df.sparkSession, name)).saveAsTable(table)
    reading_buckets(df.sparkSession, True)
    return df.sparkSession.table(table)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
