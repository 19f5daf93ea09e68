"""Word and shingle hashes inside Python tasks (numpy over Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_CACHE_WORDS = 100_000
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Cache(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class WordHasher:
    """64-bit hashes of words, with a cache of bounded size."""

    def __init__(self) -> None:
        self.cache = _Cache()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), dtype=U64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter sequence
    is one shingle as a whole, an empty one has none."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    h = words[:n - width + 1].copy()
    for j in range(1, width):
        h *= U64(0x9E3779B97F4A7C15)
        h += words[j:n - width + 1 + j]
    if width < k:
        h += U64(width)
    h = mix64(h)
    h.sort()
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def rows_of(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow record batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns])
