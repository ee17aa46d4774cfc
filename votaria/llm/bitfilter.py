"""A bit filter of 64-bit hashes, sized from their counted number, built in the JVM and applied in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the largest filter (64 MB); a fuller filter lets more rows through and loses none.
BITS_EACH = 16
MOST_BITS = 1 << 29
_LEAST_BITS = 1 << 15


def size_for(n: int) -> int:
    """The power of two of bits for ``n`` hashes."""
    return min(MOST_BITS, max(_LEAST_BITS, 1 << max(0, n * BITS_EACH - 1).bit_length()))


def build(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """The bits set by the ``n`` hashes (long) in ``column``, as bytes; at most ``MOST_BITS / 8`` of them reach the driver."""
    size = size_for(n)
    at = F.col(column).bitwiseAND(F.lit(size - 1).cast("long"))
    # positions of the built-in bitmap count from 1 within buckets of 32,768
    parts = hashes.where(F.col(column).isNotNull()).select(F.bitmap_bucket_number(at + 1).alias("k"), F.bitmap_bit_position(at + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for k, bits in parts.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (any 64-bit integers) may be in the filter."""
    at = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
