"""Words, stable hashes and shingles that the text operators share."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
_CACHE: dict[str, int] = {}
_CACHE_MAX = 500_000


def words(text: str | None) -> list[str]:
    """Words of a text in lower case; none for null."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes, equal in every process."""
    if len(_CACHE) > _CACHE_MAX:
        _CACHE.clear()
    try:
        return np.array([_CACHE[w] for w in ws], dtype=np.uint64)
    except KeyError:
        for w in ws:
            if w not in _CACHE:
                _CACHE[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([_CACHE[w] for w in ws], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, in text order; order within a shingle matters."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
    return mix(acc)


_RAW: dict[str, int] = {}
_LOWER = np.zeros(1 << 12, dtype=np.uint64)


def _numbers(ws: list[str]) -> list[int]:
    """Places of words as written in the table of their hashes."""
    global _LOWER
    try:
        return list(map(_RAW.__getitem__, ws))
    except KeyError:
        for w in ws:
            if w not in _RAW:
                n = len(_RAW)
                if n == len(_LOWER):
                    _LOWER = np.r_[_LOWER, np.zeros(n, dtype=np.uint64)]
                _LOWER[n] = xxhash.xxh3_64_intdigest(w.lower())
                _RAW[w] = n
        return list(map(_RAW.__getitem__, ws))


def shingle_sets(texts: list[str | None], k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a set, where each set starts, the sorted distinct shingle hashes of all of them).

    The same sets as np.unique(shingles(word_hashes(words(text)), k)), for at most 65,536 texts at once."""
    if len(_RAW) > _CACHE_MAX:
        _RAW.clear()
    which, size, flat = [], [], []
    for i, t in enumerate(texts):
        ws = WORD.findall(t) if t else ()
        if len(ws) >= max(min_words, k):
            which.append(i)
            size.append(len(ws))
            flat += _numbers(ws)
    if not which:
        return np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint64)
    size = np.array(size)
    s = shingles(_LOWER[np.array(flat)], k)
    own = np.repeat(np.arange(len(which), dtype=np.uint16), size)[: len(s)]
    last = np.cumsum(size)
    keep = np.arange(len(s)) + k <= last[own]  # no shingle over two texts
    s, own = s[keep], own[keep]
    order = np.argsort(s)
    order = order[np.argsort(own[order], kind="stable")]
    s, own = s[order], own[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (own[1:] != own[:-1])]
    s, own = s[new], own[new]
    return np.array(which), np.searchsorted(own, np.arange(len(which) + 1)), s
