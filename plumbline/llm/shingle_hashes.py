"""XXH64 of many word shingles at once, in numpy.

The words of many texts are joined by single spaces into one buffer, in which every shingle is a slice.
Slices of one length go through XXH64 together, a step of it for all of them; long ones, of which there
are few, one by one.  The hashes are those of the xxhash library.
"""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Slices longer than this are hashed one by one; so many of one length go together at most.
LONG, TOGETHER = 256, 1 << 13
#: The bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
#: Rows whose bits are summed in bytes, and how many such sums are made at once.
_ROWS, _SUMS = 255, 128


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _round(lane: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    return _rotated(lane + word * _P2, 31) * _P1


def _hashed(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """words: the slices' bytes as 64-bit words, a row for each word's place, a column for each slice; zeros beyond the length."""
    start, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            lanes = [start + _P1 + _P2, start + _P2, start, start - _P1]
            while at + 4 <= length // 8:
                lanes = [_round(lane, words[at + k]) for k, lane in enumerate(lanes)]
                at += 4
            out = sum((_rotated(lane, by) for lane, by in zip(lanes[1:], (7, 12, 18), strict=True)), _rotated(lanes[0], 1))
            for lane in lanes:
                out = (out ^ _rotated(lane * _P2, 31) * _P1) * _P1 + _P4
        else:
            out = np.full(words.shape[1], start + _P5)
        out = out + np.uint64(length)
        for word in words[at : length // 8]:
            out = _rotated(out ^ _round(np.uint64(0), word), 27) * _P1 + _P4
        if length % 8:
            rest, left = words[length // 8], length % 8
            if left >= 4:
                out = _rotated(out ^ (rest & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                rest, left = rest >> np.uint64(32), left - 4
            for _ in range(left):
                out = _rotated(out ^ (rest & np.uint64(255)) * _P5, 11) * _P1
                rest = rest >> np.uint64(8)
        out = (out ^ out >> np.uint64(33)) * _P2
        out = (out ^ out >> np.uint64(29)) * _P3
        return out ^ out >> np.uint64(32)


def slice_hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start : start + length] for each slice."""
    out, n = np.empty(starts.size, np.uint64), len(data)
    data += bytes(LONG)
    kinds = np.minimum(lengths, LONG + 1).astype(np.int16)
    order = np.argsort(kinds, kind="stable")
    ends = np.cumsum(np.bincount(kinds, minlength=LONG + 2))
    for size in np.unique(kinds).tolist():
        rows = order[ends[size - 1] if size else 0 : ends[size]]
        if size > LONG:
            out[rows] = [xxhash.xxh64_intdigest(data[at : at + length], seed) for at, length in zip(starts[rows].tolist(), lengths[rows].tolist(), strict=True)]
            continue
        width = -(-size // 8) or 1
        places = np.ndarray((n + 1,), f"V{8 * width}", data, 0, (1,))
        for k in range(0, rows.size, TOGETHER):
            some = rows[k : k + TOGETHER]
            out[some] = _hashed(places[starts[some]].view("<u8").reshape(-1, width).T.copy(), size, seed)
    return out


def shingle_hashes(texts: list[bytes | None], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles of `size` words, repeats included, and where each text's begin and the last's end.

    All words if there are fewer; no hash of none.  bytes.lower and bytes.split touch exactly A-Z and the six ASCII
    white-space bytes.
    """
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for k, text in enumerate(texts, 1):
        if text:
            words += text.lower().split()
        ends[k] = len(words)
    counts = np.diff(ends)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    first = np.arange(edges[-1]) + np.repeat(ends[:-1] - edges[:-1], n)
    last = first + np.repeat(np.minimum(counts, size), n) - 1
    starts = stops[first] - lengths[first]
    return slice_hashes(b" ".join(words), starts, stops[last] - starts, seed), edges


def majority_bits(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each run of hashes the bits that are set in over half of them."""
    sizes = np.diff(edges)
    # Bits are summed in bytes over _ROWS hashes at most, and those sums in full.
    parts = -(-sizes // _ROWS)
    run = np.repeat(np.arange(sizes.size), parts)
    begins = edges[run] + _ROWS * (np.arange(run.size) - np.repeat(np.cumsum(parts) - parts, parts))
    ones = np.zeros((sizes.size, 64), np.int64)
    for k in range(0, run.size, _SUMS):
        some, end = run[k : k + _SUMS], begins[k + _SUMS] if k + _SUMS < run.size else edges[-1]
        spread = _SPREAD[hashes[begins[k] : end].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(spread, begins[k : k + _SUMS] - begins[k], axis=0).view(np.uint8).astype(np.int64)
        firsts = np.flatnonzero(np.diff(some, prepend=-1))
        ones[some[firsts]] += np.add.reduceat(sums, firsts, axis=0)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
