"""Words of texts as numpy arrays: hashes, window hashes, sliding minima. ASCII white space parts words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash

BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so that they have inverses modulo 2**64


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def joined(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts in one list, and the bounds of each text in it."""
    words: list[bytes] = []
    bounds = [0]
    for t in texts:
        words += t.split()
        bounds.append(len(words))
    return words, np.array(bounds, dtype=np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each run of `width` words (also of runs across texts), by one cumulative sum. base: an odd number."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up = np.cumprod(np.full(n, base, dtype=np.uint64))
    down = np.cumprod(np.full(n - width + 1, pow(base, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up)))
    x = (sums[width:] - sums[:-width]) * down
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def other_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A second hash of each run of words, independent of the first one's sum."""
    return window_hashes((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), width, OTHER_BASE)


def inside(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each run of `width` words of n: does it lie in one text?"""
    if n < width:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n - width + 1) + width <= ends[: n - width + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima forwards and backwards in blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    top = np.iinfo(values.dtype).max
    blocks = np.concatenate((values, np.full(-n % width, top, dtype=values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def minima(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of some valid window of `width` grams; of equal minima all count."""
    least = sliding_min(grams, width)
    least = np.where(valid[: len(least)], least, 0)
    if not len(least):
        return np.zeros(0, dtype=np.int64)
    edge = np.zeros(width - 1, dtype=np.uint64)
    highest = ~sliding_min(~np.concatenate((edge, least, edge)), width)
    return np.flatnonzero((highest == grams) & (grams > 0))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of `width` words from one of the starts (a boolean per run)."""
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return np.cumsum(steps[:n]) > 0
