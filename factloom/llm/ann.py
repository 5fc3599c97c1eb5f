"""Op 4. Nearest neighbours by stable projections: a kd-tree over few random projections, with a chi-square stopping test.

A Gaussian projection to m dimensions shrinks or stretches a squared distance d to d times a chi-square variable of m degrees. So if the next leaf is
at squared distance r of the projected query and the k-th best verified row at d, a row nearer than d has been missed with probability at most
1 - F_m(r / d). Leaves are visited by their projected distance, their rows verified in the original space, until F_m(r / d) reaches ``sure``.
Largest inner products become smallest distances by one more component that gives all rows the same norm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.vectors import search, valid

PROJECTED = 8  # even: the chi-square distribution then has a short closed form


def chi_square(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """The distribution function of m (even) degrees of freedom."""
    half = np.minimum(x, 2e3) / 2
    return 1 - np.exp(-half) * sum(half ** i / math.factorial(i) for i in range(m // 2))


class Tree:
    """Rows of a block in leaves of a kd-tree over their projections, cut at the median of the widest side."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 192):
        norm = (rows ** 2).sum(axis=1)
        self.largest = float(norm.max())
        lifted = np.column_stack([rows, np.sqrt(np.maximum(self.largest - norm, 0))])
        self.matrix = np.random.default_rng(20240229).standard_normal((rows.shape[1] + 1, PROJECTED))  # the same in every block
        projected = lifted @ self.matrix
        leaves, todo = [], [np.argsort(ids, kind="stable")]
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                leaves.append(part)
                continue
            side = int(np.argmax(np.ptp(projected[part], axis=0)))
            half = np.argpartition(projected[part, side], len(part) // 2)  # copies of one vector are halved too
            todo += [part[half[:len(part) // 2]], part[half[len(part) // 2:]]]
        self.ids, self.rows = [ids[p] for p in leaves], [rows[p] for p in leaves]
        self.low = np.array([projected[p].min(axis=0) for p in leaves])
        self.high = np.array([projected[p].max(axis=0) for p in leaves])


def find(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, sure: float = 0.97, together: int = 512):
    """A round takes, for every query still open, its next nearest leaf; queries that meet at a leaf are verified in one product."""
    for first in range(0, len(queries), together):
        q, own = queries[first:first + together], query_ids[first:first + together]
        norm = (q ** 2).sum(axis=1)
        # the query's lifted component is 0; scaling it to the rows' norm changes no order and makes distances small
        scale = np.sqrt(tree.largest / norm)
        p = (q * scale[:, None]) @ tree.matrix[:-1]
        gap = np.maximum(0, np.maximum(tree.low[None] - p[:, None], p[:, None] - tree.high[None]))
        reach = (gap ** 2).sum(axis=2)
        order = np.argsort(reach, axis=1, kind="stable")
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        best = np.full((len(q), k), -np.inf)
        open_, step = np.arange(len(q)), 0
        while len(open_) and step < len(tree.ids):
            kth = best[open_, -1]
            distance = np.where(np.isinf(kth), np.inf, 2 * tree.largest - 2 * kth * scale[open_])
            next_ = reach[open_, order[open_, step]]
            with np.errstate(divide="ignore", invalid="ignore"):
                done = ~np.isinf(distance) & ((distance <= 0) & (next_ > 0) | (chi_square(next_ / np.maximum(distance, 1e-300)) >= sure))
            open_ = open_[~done]
            at = order[open_, step]
            for leaf in np.unique(at):
                some = open_[at == leaf]
                ids, scores = tree.ids[leaf], q[some] @ tree.rows[leaf].T
                scores[ids[None, :] == own[some, None]] = -np.inf
                all_ids = np.concatenate([best_ids[some], np.broadcast_to(ids, scores.shape)], axis=1)
                all_scores = np.concatenate([best[some], scores], axis=1)
                top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                best_ids[some], best[some] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_scores, top, 1)
            step += 1
        row, col = np.nonzero(best > -np.inf)
        yield row + first, best_ids[row, col], best[row, col]


def nearest(df: DataFrame, is_query: Column | None = None, k: int = 20, every: int = 20,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product in double precision, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every`` (or ``is_query`` on the column ``id``); a row is no candidate for its own id. Rows with a null id, or a
    vector that is null, empty, zero or has a null or non-finite component take no part. All rows are indexed. Fewer candidates than ``k``
    are all returned. Equal rows repeated under one id count as one. An empty table gives no row.
    """
    rows = valid(df, id_col, vector_col, zero=False)
    asked = F.pmod(F.col("id"), F.lit(every)) == 0 if is_query is None else is_query
    return search(rows, asked, k, "double", Tree, find)
