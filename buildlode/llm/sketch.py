"""A fixed-size membership sketch of 64-bit hashes, small enough to broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the sketch: 2 MB whatever the number of hashes. A fuller sketch lets more
#: false candidates through, which the exact join after it removes.
BITS = 1 << 24


def membership(hashes: DataFrame, column: str) -> np.ndarray:
    """Bloom filter with two probes, built by Spark; at most BITS / 64 rows are collected."""
    h = F.col(column)
    probes = F.array(h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(BITS - 1))
    words = (
        hashes.select(F.explode(probes).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def maybe(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that the sketch may hold; none that it holds is missed."""
    at = np.arange(len(hashes))
    for shift in (0, 32):
        p = (hashes[at] >> np.uint64(shift)) & np.uint64(BITS - 1)
        at = at[((sketch[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)]
    return at
