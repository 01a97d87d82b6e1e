"""Compressed sets of 16-bit numbers: the sorted numbers, or 65,536 bits, whichever is shorter."""

from __future__ import annotations

import numpy as np

_BITS = 8192


def pack(low: np.ndarray) -> bytes:
    """Sorted numbers while they take fewer bytes than all bits do."""
    low = np.unique(np.asarray(low, dtype=np.int64)).astype("<u2")
    if low.nbytes < _BITS:
        return low.tobytes()
    flags = np.zeros(65536, dtype=np.uint8)
    flags[low] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < _BITS:
        return np.frombuffer(bitmap, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little")).astype("<u2")


def union(bitmaps: list[bytes]) -> bytes:
    if len(bitmaps) == 1:
        return bitmaps[0]
    if any(len(b) == _BITS for b in bitmaps):
        bits = np.zeros(_BITS, dtype=np.uint8)
        for b in bitmaps:
            if len(b) == _BITS:
                bits |= np.frombuffer(b, dtype=np.uint8)
            else:
                low = np.frombuffer(b, dtype="<u2").astype(np.int64)
                np.bitwise_or.at(bits, low >> 3, np.left_shift(1, low & 7).astype(np.uint8))
        return bits.tobytes()
    return pack(np.concatenate([np.frombuffer(b, dtype="<u2") for b in bitmaps]))


def cardinality(bitmap: bytes) -> int:
    if len(bitmap) < _BITS:
        return len(bitmap) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, dtype=np.uint8)).sum())


def contains(bitmap: bytes, low: int) -> bool:
    if len(bitmap) == _BITS:
        return bool(bitmap[low >> 3] >> (low & 7) & 1)
    numbers = np.frombuffer(bitmap, dtype="<u2")
    at = int(np.searchsorted(numbers, low))
    return at < len(numbers) and int(numbers[at]) == low
