"""Elias-Fano coding of a non-decreasing sequence: near-minimal space, constant-time select.

Each value's low bits stand in a packed array; its high part is the number of zeros before its one in
a bit vector.  Every SAMPLE-th one's position is stored, so select reads a short stretch.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QQBQQ")


class EliasFano:
    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: non-negative, non-decreasing, below 2**63."""
        values = np.asarray(values, dtype=np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th value, from its sampled neighbourhood alone."""
        return int(self.select_run(i, i + 1)[0])

    def select_run(self, i: int, j: int) -> np.ndarray:
        """The values i to j - 1: one select and the bits from there on, so memory follows the run."""
        if not 0 <= i < j <= self.n:
            raise IndexError((i, j))
        start, rank, last = int(self.samples[i // SAMPLE]), i % SAMPLE, i % SAMPLE + j - i
        byte, width = start // 8, 8 + (last * 3) // 8
        while True:
            found = np.flatnonzero(np.unpackbits(self.high[byte : byte + width], bitorder="little")[start - 8 * byte :])
            if len(found) >= last:
                break
            width *= 4
        ones = start + found[rank:last]
        return ((ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i, j)

    def _low(self, i: int, j: int) -> np.ndarray:
        first, width = i * self.low_bits, self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (j * width + 7) // 8], bitorder="little")[first % 8 :][: (j - i) * width]
        return (bits.reshape(j - i, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        """Every value: for small codes only, it is a full table."""
        return self.select_run(0, self.n) if self.n else np.empty(0, np.uint64)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low_bits, n_low, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u8", -1, at + n_low + n_high))
