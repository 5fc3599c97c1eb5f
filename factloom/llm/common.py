"""Small helpers of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_HELD: dict = {}


def _give_back() -> None:
    """Free what a dropped model held, cycles too, and return it to the system, as an idle worker stays beside the executor's heap."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: its own allocator decides
        pass


def held(key, make: Callable[[], object]):
    """One model for each worker process: it stays until another is asked for, so the models of a job's stages do not add up in a reused worker."""
    if _HELD.get("key") != key:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD.update(key=key, model=make())
    return _HELD["model"]


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) of ``df``; all other columns go, so none can clash."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)


def arrow_type(ddl: str) -> pa.Schema:
    """An Arrow schema from "name type, ..." with the few types that the operators return."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def in_parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows``, so that only few texts are Python strings at a time."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def map_rows(df: DataFrame, ddl: str, batch_fn: Callable[[pa.RecordBatch], dict[str, list]]) -> DataFrame:
    """``mapInArrow`` with one dict of columns for each batch."""
    schema = arrow_type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(batch_fn(batch), schema=schema)

    return df.mapInArrow(run, ddl)


def bounded_sample(df: DataFrame, id_col: str, rows: int, by: str | None = None, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (for each value of ``by``) with the smallest hashes of their id; all rows where there are fewer.

    One counting pass finds the share to keep; the rows kept depend on ids alone, not on partitions or machines.
    """
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 30))
    if by is None:
        total = df.count()
        return df.filter(hashed < F.lit(int((1 << 30) * min(1.0, rows / max(total, 1)))))
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = F.when(F.col(by) == F.lit(value), hashed < F.lit(int((1 << 30) * min(1.0, rows / n)))).otherwise(keep)
    return df.filter(keep)


BUCKETS = 1 << 20


def _hit(df: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose id falls into one of the hash buckets of ``ids`` (or into none): a broadcast of at most ``BUCKETS`` numbers."""
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(BUCKETS))
    used = ids.select(F.pmod(F.xxhash64(ids[ids.columns[0]].cast("bigint")), F.lit(BUCKETS)).alias("_bucket")).distinct()
    return df.withColumn("_of", bucket).join(F.broadcast(used), F.col("_of") == F.col("_bucket"), how).drop("_of")


def with_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in the stored one-column table ``ids``. Only rows in a bucket of ``ids`` are shuffled."""
    some = _hit(df, id_col, ids, "left_semi")
    return some.join(ids.toDF("_wanted"), some[id_col] == F.col("_wanted"), "left_semi")


def without_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in the stored one-column table ``ids``, those with a null id among them; shuffles as ``with_ids``."""
    some = _hit(df, id_col, ids, "left_semi")
    return _hit(df, id_col, ids, "left_anti").unionByName(some.join(ids.toDF("_wanted"), some[id_col] == F.col("_wanted"), "left_anti"))
