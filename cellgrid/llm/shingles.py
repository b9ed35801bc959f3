"""Words and word shingles of UTF-8 texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a Python worker remembers; about 100 bytes each.
REMEMBERED = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of a word, computed at its first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; none if there are fewer."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, width):
        out = mixed(out * ODD + hashes[k : k + count])
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z in lower case, words cut at ASCII white space.

    A text with fewer words than ``width`` has its whole sequence as its one shingle, and one
    without words has none. ``bytes.split`` cuts at exactly the bytes 09-0D and 20.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        short = np.uint64(len(words))
        for h in hashes:
            short = mixed(np.array([short], np.uint64) * ODD + h)[0]
        return np.array([short], np.uint64)
    return np.unique(windows(hashes, width))
