"""Words and word shingles of whole texts, as hashes."""

import numpy as np
import xxhash

#: Hashes of words that a process remembers at most; then it starts anew.
REMEMBERED = 200_000
# Odd multipliers without a simple relation, one for each place in a shingle.
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and tab to carriage return, with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.array(list(map(_HASHES.__getitem__, w)), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(w: list[bytes], k: int = 5) -> np.ndarray:
    """The hash of each run of k words in order; of fewer words, one hash of the whole sequence; none without words."""
    n = len(w)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    h, size = word_hashes(w), min(n, k)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out += h[i : n - size + 1 + i] * _PLACES[i]
    return mixed(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct shingle hashes of the whole text, sorted."""
    return np.unique(shingle_hashes(words(text), k))
