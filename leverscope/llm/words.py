"""Words of a text and their 64-bit hashes, as duplicate search and language models take them."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS, WORD_BYTES = 300_000, 64  # bounds of a worker's table of hashed words


class WordHasher:
    """A-Z lower-cased; words are what blanks, tabs, line feeds, VT, FF and CR leave (``bytes.split``)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        found = {w: known[w] if w in known else xxhash.xxh64_intdigest(w) for w in set(words)}
        known.update((w, h) for w, h in found.items() if len(w) <= WORD_BYTES)
        return np.array([found[w] for w in words], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Ascending distinct hashes of runs of ``width`` words; of fewer words the whole run; of none nothing."""
    if not len(words):
        return words
    n = min(width, len(words))
    runs = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(runs)
