"""A Bloom filter that grows with its keys: a scan lets pass all rows of given keys and about one in a hundred of the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantry.llm.shared import swept

LEAST, MOST = 1 << 24, 1 << 29  # bits; 64 MB at most, which holds 54 million keys: with more, more rows pass
PER_KEY, HASHES = 10, 4  # bits at least


def place(key: str) -> Column:
    """The hash of a long key from which its bits are taken."""
    return F.xxhash64(F.col(key).cast("long"))


def of(keys: DataFrame, key: str = "key", hashed: bool = False) -> np.ndarray:
    """The filter of all keys, put together in the cluster. hashed: the key is a hash itself."""
    with swept(keys.sparkSession):
        n, bits = keys.agg(F.approx_count_distinct(key)).first()[0], LEAST
        while bits < min(PER_KEY * n, MOST):
            bits *= 2
        h = F.col(key) if hashed else place(key)
        low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)
        places = keys.select(F.explode(F.array(*[(low + F.lit(i) * high).bitwiseAND(F.lit(bits - 1)) + 1 for i in range(HASHES)])).alias("bit"))  # the bitmap functions count from 1
        rows = places.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes of keys may be among those of the filter."""
    hashes, last = hashes.astype(np.uint64), np.uint64(8 * len(bitmap) - 1)
    found = np.arange(len(hashes))
    for i in range(HASHES):
        at = ((hashes[found] & np.uint64((1 << 32) - 1)) + np.uint64(i) * (hashes[found] >> np.uint64(32))) & last
        found = found[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    out = np.zeros(len(hashes), bool)
    out[found] = True
    return out
