"""Hashed word shingles and MinHash signatures of texts, for use in tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


@lru_cache
def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Only A-Z are lower-cased, and words end at ASCII white space. A text with
    fewer words than ``size`` is one shingle; one without words has none.
    """
    # bytes.lower() and bytes.split() know ASCII only, which is just this rule.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for j, f in enumerate(_factors(size, 10)[:k]):
        total += h[j : j + n] * f
    return np.unique(_mixed(total))


def similar_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (32 bit) of a set that isn't empty."""
    a = (_factors(n, 11) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    b = (_factors(n, 12) >> np.uint64(32)).astype(np.uint32)[:, None]
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        part = a * h[at : at + 1024][None, :]
        part += b
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` values."""
    bands = sig.reshape(-1, rows).astype(np.uint64)
    keys = (bands * _factors(rows, 13)[None, :]).sum(axis=1, dtype=np.uint64)
    return _mixed(keys + np.arange(len(bands), dtype=np.uint64) * _factors(1, 14)[0]).astype(np.int64)
