"""Words of many texts at once: byte places and 64-bit hashes, with numpy over an Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier of rolling hashes, its inverse modulo 2**64, and a random value for each byte.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64, kept for the next call."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[first:end] for each span, whatever stands before it."""
    n = len(values)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(STEP, n), dtype=np.uint64)])
    return mixed((sums[end] - sums[first]) * powers(BACK, n + 1)[first] + (end - first).astype(np.uint64))


class Words:
    """The words between ASCII white space of a column of texts.

    data: all bytes; begin, end: each word's place in them; row: the text each is from; hash: of each;
    first: each text's first word, and after the last text the number of words. Null is a text without words.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data, at - at[0]
        letter = ~SPACE[data]
        before = np.concatenate([[False], letter[:-1]]) if len(data) else letter
        after = np.concatenate([letter[1:], [False]]) if len(data) else letter
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.begin = np.nonzero(letter & ~before)[0]
        self.end = np.nonzero(letter & ~after)[0] + 1
        self.first = np.searchsorted(self.begin, self.offsets)
        self.row = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hash = spans_hash(BYTE[data], self.begin, self.end)

    def joined(self, first: int, end: int) -> bytes:
        """Some words with one space between."""
        return b" ".join(self.list(first, end))

    def list(self, first: int, end: int) -> list[bytes]:
        data = self.data
        return [data[a:b].tobytes() for a, b in zip(self.begin[first:end].tolist(), self.end[first:end].tolist())]
