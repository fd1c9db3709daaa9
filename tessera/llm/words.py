"""Hashes of the words of many texts at once, with numpy.

The hash of bytes b0 b1 ... is the sum of (b + 1) times a power of an odd base, modulo
2**64, mixed at the end.  With running sums over a block of text the hash of any span is
a difference, shifted back to power zero: no loop over words.
"""

from __future__ import annotations

import functools

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


BLOCK = 1 << 20
"""Bytes that are hashed together; powers are kept for twice as many."""


def _made(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    return made[0], made[1]


@functools.lru_cache(maxsize=2)
def _kept(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _made(base, 2 * BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hashes of the spans of ``data`` (bytes), in order, equal for equal bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    for low in range(0, max(len(data), 1), BLOCK):
        a, b = np.searchsorted(starts, [low, low + BLOCK]).tolist()
        if a < b:
            first, last = int(starts[a]), int(ends[a:b].max())
            out[a:b] = _block(data[first:last], starts[a:b] - first, ends[a:b] - first, base)
    return out


def _block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _kept(base) if len(data) <= 2 * BLOCK else _made(base, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])
