"""Op 9. Exact top-k inner products by aggregation without random access.

Each dimension is a sorted list, read from the top for a positive query component and from the bottom for a negative one. What has been read of a
row adds up; for the rest of it, the last value read of a list bounds it from above and the list's far end from below. Reading goes on in growing
steps until no other row can reach the k-th lower bound; the scores of those left are then resolved exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.vectors import search, valid




class Lists:
    """The sorted lists of a block, as each row's value, and the value at each depth from either end."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.sorted = np.sort(self.rows, axis=0)


def find(lists: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int, together: int = 128):
    """Queries are read through the lists in batches; a round reads each list to the same depth for all of them."""
    n = len(lists.ids)
    least, most = lists.sorted[0], lists.sorted[-1]
    for first in range(0, len(queries), together):
        q = queries[first:first + together]
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
        want = k + 1  # one more, for the query's own row
        alive = np.arange(n)
        depth = max(want, n // 8)
        while depth < n and len(alive) > 4 * want:
            top, bottom = lists.sorted[n - depth], lists.sorted[depth - 1]
            rows = lists.rows[alive]
            upper = np.where(rows >= top, rows, top) @ up + np.where(rows <= bottom, rows, bottom) @ down
            lower = np.where(rows >= top, rows, least) @ up + np.where(rows <= bottom, rows, most) @ down
            kth = np.partition(lower, len(alive) - want, axis=0)[len(alive) - want]
            rest = (upper >= kth).any(axis=1)  # rows that some query of the batch cannot rule out yet
            alive, depth = alive[rest], depth * 2
        scores = lists.rows[alive] @ q.T
        ids = lists.ids[alive]
        at, found, values = [], [], []
        own = ids[:, None] == query_ids[None, first:first + together]
        scores = np.where(own, -np.inf, scores)
        keep = min(k, len(alive))
        for j in range(len(q)):
            column = scores[:, j]
            kth = np.partition(column, len(column) - keep)[len(column) - keep] if keep else 0
            near = np.flatnonzero((column >= kth) & (column > -np.inf))
            near = near[np.lexsort((ids[near], -column[near]))][:k]
            at.append(np.full(len(near), first + j))
            found.append(ids[near])
            values.append(column[near])
        yield np.concatenate(at), np.concatenate(found), np.concatenate(values).astype(np.int64)


def top_products(df: DataFrame, is_query: Column | None = None, k: int = 5, scale: int = 256, every: int = 50,
                 id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` rows of largest integer inner product, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every`` (or ``is_query`` on the column ``id``). Rows with a null
    id, or a vector that is null, empty or has a null or non-finite component take no part; zero vectors do. A row is no candidate for its own id.
    Rows repeated under one id count as one if they are equal. An empty table gives no row.
    """
    rows = valid(df, id_col, vector_col, zero=True).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    asked = F.pmod(F.col("id"), F.lit(every)) == 0 if is_query is None else is_query
    return search(rows, asked, k, "bigint", Lists, find)


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % {every} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
