"""Blocks of vectors for the two searches: candidates are dealt into bounded blocks, query blocks visit each, the best are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import arrow_type


def valid(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """id, v (doubles) of the rows that take part: id not null, no null or non-finite component, not empty, and not zero unless ``zero``."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    limit = F.lit(float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) &
                       F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)))
    return rows if zero else rows.filter(F.exists(v, lambda x: x != 0))


def search(rows: DataFrame, is_query: Column, k: int, score: str,
           index: Callable[[np.ndarray, np.ndarray], object], find: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]],
           block_rows: int = 20_000, query_rows: int = 2_000) -> DataFrame:
    """The ``k`` best rows for each query: query_id, rank, vec_id, score (of SQL type ``score``).

    Candidates are dealt by a hash of their id into blocks of about ``block_rows``; every query goes to every block (a stated query set against
    all rows). ``index(ids, vectors)`` is built once in the task of a block, and ``find(index, query_ids, queries, k)`` yields the best of the
    block for batches of queries: positions of the queries, candidate ids, scores. Only k rows for each query and block leave a task.
    Vectors of another length than a block's queries meet only their own kind.
    """
    n = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n)).cast("int")).withColumn("q", F.lit(0))
    asked = rows.filter(is_query).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("q", F.lit(1))
    out = f"query_id bigint, vec_id bigint, score {score}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, candidates before queries, and by id; queries are answered as soon as ``query_rows`` of them are there."""
        here, ids, vectors, built, qids, queries = None, [], [], None, [], []
        last, seen = None, set()  # an id's equal rows follow one another, and count once

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal built, qids, queries
            if built is None:
                built = {}
                for size in {len(v) for v in vectors}:
                    same = [i for i, v in enumerate(vectors) if len(v) == size]
                    built[size] = index(np.array([ids[i] for i in same], np.int64), np.array([vectors[i] for i in same], np.float64))
            for size in {len(v) for v in queries}:
                same = [i for i, v in enumerate(queries) if len(v) == size]
                if size in built:
                    asked_ids = np.array([qids[i] for i in same], np.int64)
                    for at, found, scores in find(built[size], asked_ids, np.array([queries[i] for i in same], np.float64), k):
                        yield pa.RecordBatch.from_pydict({"query_id": asked_ids[at], "vec_id": found, "score": scores}, schema=arrow_type(out))
            qids, queries = [], []

        for batch in batches:
            for block, q, i, v in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "q", "id", "v"))):
                if block != here:
                    yield from answer() if qids else ()
                    here, ids, vectors, built = block, [], [], None
                if (block, q, i) != last:
                    last, seen = (block, q, i), set()
                if (key := v.tobytes()) in seen:
                    continue
                seen.add(key)
                if q:
                    qids.append(i)
                    queries.append(v)
                    if len(qids) >= query_rows:
                        yield from answer()
                else:
                    ids.append(i)
                    vectors.append(v)
        yield from answer() if qids else ()

    best = (dealt.unionByName(asked).repartition(n, "block").sortWithinPartitions("block", "q", "id").mapInArrow(run, out))
    # a candidate's copies under one id are rows of their own; each query keeps at most k rows for each block before this shuffle
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
