"""A Bloom filter of bounded size over the numbers of a column, filled in tasks.

It only saves work: a number that was put in always passes, and what passes by chance is
told apart by whoever asks.  With more numbers than the bound has room for, more pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix

#: bytes at most, and so what is collected and broadcast
MAX_BYTES = 32 << 20
#: the filter is filled in so many separate parts
PARTS = 13


@dataclass(frozen=True)
class Bloom:
    parts: np.ndarray  # PARTS rows of bytes
    hashes: int

    def passes(self, x: np.ndarray) -> np.ndarray:
        part = np.mod(x, PARTS)
        at = _places(x, self.parts.shape[1] * 8, self.hashes)
        return ((self.parts[part[:, None], at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def _places(x: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    h = mix(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h[:, None] + (mix(h) | np.uint64(1))[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def build(numbers: DataFrame, count: int, max_bytes: int = MAX_BYTES) -> Bloom:
    """Of the first column (long, without nulls), which has about ``count`` values."""
    size = -(-min(max_bytes, max(1024, 2 * count)) // PARTS)
    hashes = max(1, min(6, round(0.69 * 8 * size * PARTS / max(1, count))))
    name = numbers.columns[0]

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            part = np.mod(x, PARTS)
            for k in np.unique(part).tolist():
                bits = held.setdefault(k, np.zeros(size * 8, bool))
                bits[_places(x[part == k], size * 8, hashes).ravel()] = True
        for k, bits in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["k", "v"])

    rows = numbers.select(F.col(name).cast("long").alias("x"), F.pmod(F.col(name).cast("long"), F.lit(PARTS)).cast("int").alias("k"))
    out = np.zeros((PARTS, size), np.uint8)
    for r in rows.repartition(PARTS, "k").select("x").mapInArrow(fill, "k int, v binary").collect():
        out[r["k"]] = np.frombuffer(r["v"], np.uint8)
    return Bloom(out, hashes)
