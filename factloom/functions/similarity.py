"""Indel similarity: 200 * LCS / (len a + len b)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(texts: pd.Series, pad: int) -> np.ndarray:
    """Code points as one padded matrix."""
    size = texts.str.len().to_numpy(dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
    out = np.full((len(size), int(size.max(initial=0))), pad, dtype=np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def lcs_lengths(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Longest common subsequence of each pair: one dynamic-programming row at a time for the whole batch."""
    left, right = _codes(a, -1), _codes(b, -2)
    best = np.zeros((len(left), right.shape[1] + 1), dtype=np.int32)
    for i in range(left.shape[1]):
        step = best.copy()
        step[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + (left[:, i:i + 1] == right))
        best = np.maximum.accumulate(step, axis=1)
    return best[:, -1]


def _lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    # long strings and short ones apart, so that padding stays small
    out = np.zeros(len(a), dtype=np.int32)
    order = np.argsort((a.str.len() + b.str.len()).to_numpy(), kind="stable")
    for start in range(0, len(order), 2048):
        rows = order[start:start + 2048]
        out[rows] = lcs_lengths(a.iloc[rows], b.iloc[rows])
    return pd.Series(out)


# said to be undetermined so that a filter on it stays above: Spark took it below the distinct pairs and computed it for every meeting of a pair, and then once more
lcs_length = F.pandas_udf(_lcs_length, T.IntegerType()).asNondeterministic()


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)
