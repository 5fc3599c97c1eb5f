"""Incremental entity upserts with state.

Per entity the store keeps its aliases and the earliest and the latest sighting by ``seq``. What a sighting
changes depends on its ``seq`` alone, not on when it arrives, so late, repeated and replayed rows end in the same entity.
A micro-batch emits the entities it touched and writes them to its own folder, as the edge upsert does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.operators.graph import latest_per_key

#: A sighting: the entity, its name and type there, one of its aliases, and a number that orders sightings.
SIGHTING = "id string, name string, type string, alias string, seq bigint"
ENTITY = "id string, name string, type string, first_type string, aliases array<string>, first_seq bigint, last_seq bigint"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EntityState(StatefulProcessor):
    """One value for each entity, so that a sighting costs one read and one write of the store however many aliases it has; aliases are distinct there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._entity = handle.getValueState("entity", "name string, type string, last_seq bigint, first_type string, first_seq bigint, aliases array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Rows as of SIGHTING."""
        low = high = None
        aliases = set()
        for _, name, type, alias, seq in rows:
            place = (seq, name is not None, name or "", type is not None, type or "")
            if high is None or place >= high[0]:
                high = (place, name, type)
            if low is None or place < low[0]:
                low = (place, type)
            if alias is not None:
                aliases.add(alias)
        last, first = (high[1], high[2], high[0][0]), (low[1], low[0][0])
        known = self._entity.get()
        if known is not None:
            if last[2] < known[2]:
                last = tuple(known[:3])
            if first[1] >= known[4]:
                first = tuple(known[3:5])
            aliases.update(known[5])
        every = sorted(aliases)
        self._entity.update((*last, *first, every))
        yield Row(id=key[0], name=last[0], type=last[1], first_type=first[0], aliases=every, first_seq=first[1], last_seq=last[2])

    def close(self) -> None:
        pass


def stream_entities(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start the upsert of sightings into ``target``. Ids and seqs are not null; seqs of an entity are unique or their rows equal.

    The query runs on the RocksDB state store, which keeps state out of the heap; the session's own choice is set back once it has started.
    """
    sightings = source.select(*[field.split()[0] for field in SIGHTING.split(", ")])
    rows = sightings.groupBy("id").transformWithState(EntityState(), outputStructType=ENTITY, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id:012d}")

    conf = source.sparkSession.conf
    before = conf.get(PROVIDER_CONF, None)
    conf.set(PROVIDER_CONF, PROVIDER)
    try:
        return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER_CONF, before) if before else conf.unset(PROVIDER_CONF)


def read_entities(spark: SparkSession, target: str) -> DataFrame:
    """Every entity as its latest batch left it."""
    rows = spark.read.option("basePath", target).parquet(f"{target.rstrip('/')}/batch=*")
    return latest_per_key(rows.withColumn("batch", F.col("batch").cast("bigint")), ["id"], ["batch"]).drop("batch")
