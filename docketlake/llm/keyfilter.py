"""A bounded filter of 64-bit keys that tasks test their rows with before they send them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each of its keys, and the power of two that bounds them (128 MB).
BITS_A_KEY, MOST_BITS = 16, 30
#: Bits of a block, as a power of two: a task puts a block together, the driver the blocks.
BLOCK = 20


def build(keys: DataFrame, key: str = "key", most_bits: int = MOST_BITS) -> np.ndarray:
    """Bit set of a column of 64-bit hashes.

    It has no false negatives, so whoever counts exactly afterwards gets the same result with any filter; a full
    one only lets more rows pass. The driver gets the bits themselves, 2^most_bits at most, whatever the number of keys.
    """
    size = min(most_bits, max(BLOCK, (BITS_A_KEY * keys.count()).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << size) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(({key} & 63) as int))")).alias("bits"))

    def block(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << (BLOCK - 6), dtype=np.uint64)
        places = rows["at"].to_numpy()
        bits[places & ((1 << (BLOCK - 6)) - 1)] = rows["bits"].to_numpy().view(np.uint64)
        return pa.table({"block": pa.array([int(places[0]) >> (BLOCK - 6)], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    found = words.groupBy(F.shiftright("at", BLOCK - 6).alias("block")).applyInArrow(block, "block long, bits binary").toArrow()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    for k, bits in zip(found["block"].to_pylist(), found["bits"], strict=True):
        out[k << (BLOCK - 6) : (k + 1) << (BLOCK - 6)] = np.frombuffer(bits.as_buffer(), dtype=np.uint64)
    return out


def has(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may be in the set."""
    at = keys & np.uint64((len(filter_bits) << 6) - 1)
    return (filter_bits.take((at >> np.uint64(6)).view(np.int64)) >> (at & np.uint64(63))) & np.uint64(1) == 1
