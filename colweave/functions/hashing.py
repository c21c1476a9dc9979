"""Hash draws used in place of global random state.

``md5_unit`` maps a string to [0, 1) from the first 32 bits of its MD5 digest;
the same arithmetic is available in SQL engines, so sampled sets can be checked.
``murmur3_fraction`` reproduces the golden-ratio fraction of a signed 32-bit
MurmurHash3 (seed 42) exactly; Spark's own ``hash`` treats tail bytes
differently, so it is computed in an Arrow-batched pandas UDF, on distinct
values only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .vocab import PHI_FRACTION

TWO_32 = 4294967296.0


def md5_unit(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def seeded_unit(c: Column, seed: int) -> Column:
    return md5_unit(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def murmur3_32(data: bytes, seed: int = 42) -> int:
    """Signed 32-bit MurmurHash3 (x86_32) of ``data``."""
    c1, c2 = 0xCC9E2D51, 0x1B873593
    h = seed & 0xFFFFFFFF
    n = len(data)
    nblocks = n // 4
    for i in range(nblocks):
        k = int.from_bytes(data[4 * i : 4 * i + 4], "little")
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
        h = ((h << 13) | (h >> 19)) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    tail = data[4 * nblocks :]
    k = 0
    if len(tail) >= 3:
        k ^= tail[2] << 16
    if len(tail) >= 2:
        k ^= tail[1] << 8
    if len(tail) >= 1:
        k ^= tail[0]
        k = (k * c1) & 0xFFFFFFFF
        k = ((k << 15) | (k >> 17)) & 0xFFFFFFFF
        k = (k * c2) & 0xFFFFFFFF
        h ^= k
    h ^= n
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    h = (h * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h & 0x80000000 else h


def fibonacci_fraction(h: int) -> float:
    return (h * PHI_FRACTION) % 1.0


@F.pandas_udf(DoubleType())
def murmur3_fraction(values: pd.Series) -> pd.Series:
    out = np.empty(len(values), dtype="float64")
    for i, v in enumerate(values):
        out[i] = np.nan if v is None else fibonacci_fraction(murmur3_32(str(v).encode("utf-8"), 42))
    return pd.Series(out)
