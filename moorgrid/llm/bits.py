"""A Bloom filter of 64-bit keys as one array of 64-bit words: four bits of one word per key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 20  # 8 MiB, whatever the number of keys; beyond it only more keys pass


def filter_of(keys: DataFrame, bits_per_key: int = 16, most: int = MAX_WORDS) -> np.ndarray:
    """The filter of the first column's distinct keys; it is built by aggregation, the driver gets its words alone."""
    c = keys.columns[0]
    n = int(min(most, max(1024, keys.count() * bits_per_key // 64)))
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({c}, {6 * k}) & 63 as int))" for k in range(4)))
    rows = keys.select(F.pmod(F.shiftright(c, 24), F.lit(n)).cast("int").alias("word"), mask.alias("m"))
    got = rows.groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()  # at most n rows
    out = np.zeros(n, dtype=np.int64)
    out[got["word"].to_numpy()] = got["m"].to_numpy()
    return out


def passes(filt: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (of any shape) may be in the filter; false is certain."""
    k = keys.view(np.int64)
    m = np.zeros(k.shape, dtype=np.int64)
    for j in range(4):
        m |= np.int64(1) << ((keys >> np.uint64(6 * j)) & np.uint64(63)).astype(np.int64)
    return (filt[(k >> np.int64(24)) % len(filt)] & m) == m
