"""Word shingles as sets of 64-bit hashes, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
CACHE_WORDS = 200_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class WordHashes(dict):
    """Hash of each word, kept for words seen again; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_list(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of all words if there are fewer; empty without words."""
    h = word_hashes(word_list(text))
    if not len(h):
        return h
    runs = max(1, len(h) - size + 1)
    width = min(size, len(h))
    total = np.full(runs, width, np.uint64)
    for i in range(width):
        total = mix(total ^ (h[i : i + runs] * _ODD[i % len(_ODD)]))
    return np.unique(total)
