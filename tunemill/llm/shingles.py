"""Words and shingles of whole texts as numpy arrays, for the operators that hash them."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words; starts anew when it holds too many, so its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and splits at the ASCII white space x09-x0D and x20."""
    return text.encode(errors="surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of the word hashes; with fewer words, of the whole sequence as one."""
    n = min(n, len(h))
    if n == 0:
        return h[:0]
    out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        out = mixed(out * _STEP + h[i : len(h) - n + 1 + i])
    return out
