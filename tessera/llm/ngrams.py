"""Hashed byte n-grams of texts."""

from __future__ import annotations

import numpy as np

SPACE = ord(" ")
_SIGNS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalpha()), b" " * 76)


def letters(text: str) -> bytes:
    """Lower case, all ASCII but letters as spaces, a space at both ends."""
    return f" {text.lower()} ".encode().translate(_SIGNS)


def trigram_buckets(data: bytes, bits: int) -> np.ndarray:
    """A bucket for each three bytes in a row."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def trigram_counts(data: bytes, bits: int) -> np.ndarray:
    return np.bincount(trigram_buckets(data, bits), minlength=1 << bits)
