"""Bloom filters of bounded size over 64-bit keys, built in tasks and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .words import U

#: Bits a key, slices of a filter, and most bits: 32 MB, whatever the number of keys.
BITS, SLICES, MOST = 12, 64, 1 << 28
#: Keys that a filter tells apart from others; of more, it lets all pass.
KEYS = MOST // BITS


# XXH64 of a 64-bit number with seed 42, which is Spark's xxhash64.
_P1, _P2, _P3, _P4, _P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed(keys: np.ndarray) -> np.ndarray:
    """xxhash64 of each key, as Spark has it."""
    turn = lambda h, n: h << U(n) | h >> U(64 - n)
    h = (U(42 + 8) + _P5) ^ turn(keys.view(np.uint64) * _P2, 31) * _P1
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ h >> U(33)) * _P2
    h = (h ^ h >> U(29)) * _P3
    return h ^ h >> U(32)


def places(keys: np.ndarray, slice_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slice of each key and two bits in it; slice_bits is a power of two."""
    h = hashed(keys)
    low = U(slice_bits - 1)
    return (h >> U(58)).astype(np.int64), h & low, (h >> U(28)) & low


def slice_size(n: int) -> int:
    bits = max(1 << 10, BITS * n // SLICES)
    return min(MOST // SLICES, 1 << (bits - 1).bit_length())


def build(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A filter (SLICES x bytes) that holds all values of a long column; no key is missed, some others pass."""
    size = slice_size(n)
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        # slices made so far in this task, at most the whole filter
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            s, a, b = places(np.asarray(batch.column(0)), size)
            for k in np.unique(s).tolist():
                bits = mine.setdefault(k, np.zeros(size // 8, np.uint8))
                for at in (a[s == k], b[s == k]):
                    np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8))
        for k, bits in mine.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], schema=schema)

    out = np.zeros((SLICES, size // 8), np.uint8)
    # a slice's keys go to one task, so that the driver gets each slice once
    dealt = keys.select(F.col(column).cast("long").alias("k")).repartition(SLICES // 4, F.shiftrightunsigned(F.xxhash64("k"), 58))
    for row in dealt.mapInArrow(lean(run), "slice int, bits binary").toLocalIterator():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    s, a, b = places(keys, filter_.shape[1] * 8)
    one = lambda at: filter_[s, (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & np.uint8(1)
    return (one(a) & one(b)).astype(bool)
