"""Bitmaps of a fixed size that tell tasks which keys may be wanted. A set bit may be wrong, a clear one never is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BITS = 26


def positions(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return mix(keys.astype(np.uint64), 77) >> np.uint64(64 - bits)


def collect_bitmap(positions_df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """2**bits bits as bytes, set at the positions in a column (longs below 2**bits). Words of 64 bits are built in
    Spark; at most 2**(bits - 6) rows reach the driver, whatever the input."""
    words = positions_df.groupBy(F.shiftright(column, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def contains(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    at = positions(keys, bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
