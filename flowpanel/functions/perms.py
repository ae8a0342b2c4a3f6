"""Keyed random permutations of 0..n−1, one value at a time.

A Feistel network over the smallest even number of bits that holds n − 1 is a bijection for
every key; values that fall outside 0..n−1 walk its cycle until they are inside.  So a
permuted position needs neither a sort nor the other positions, and a recomputed row gets
the same one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

ROUNDS = 6
_U = np.uint64


def permute(x: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Position of x (0..n−1) under the permutation that ``key`` names."""
    half = _U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (_U(1) << half) - _U(1)
    key = key.astype(np.int64).view(_U)

    def once(v, k):
        left, right = v >> half, v & mask
        for r in range(ROUNDS):
            h = (right + k) * _U(0x9E3779B97F4A7C15) + _U(r + 1) * _U(0xD1B54A32D192ED03)
            h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> _U(32))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(x.astype(_U), key)
        live = np.flatnonzero(out >= n)
        while len(live):
            out[live] = once(out[live], key[live])
            live = live[out[live] >= n]
    return out.astype(np.int64)


def permuted(x: Column, key: Column, n: int) -> Column:
    """Column form of :func:`permute`; NULLs are not expected."""
    @pandas_udf("long")
    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(permute(v.to_numpy(), k.to_numpy(), n))

    return run(x, key)
