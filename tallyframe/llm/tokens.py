"""Words of whole texts as numpy arrays of 64-bit hashes.

A word is a maximal run of letters, digits and combining marks, lower-cased by code point.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
#: Code points that are handled at once; bounds the memory of the arrays.
CHUNK_CHARS = 1_000_000


@lru_cache(1)
def _lower() -> np.ndarray:
    """For each code point its lower-case form, or 0 if it is no part of a word."""
    lower = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    return lower


@lru_cache(2)
def _powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base."""
    powers = np.full(n, _PRIME)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_chars(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in an array of code points."""
    low = _lower()[chars]
    inside = np.empty(len(low) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(low, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    first = starts[0]
    place = np.arange(len(low) - first) - np.repeat(starts - first, np.diff(starts, append=len(low)))
    powers = _powers(1 << max(12, int(place.max()).bit_length()))  # one for each place, however long a word is
    terms = low[first:].astype(np.uint64) * powers[place]  # what is no word has 0
    return mix(np.add.reduceat(terms, starts - first) + (ends - starts).astype(np.uint64) * _LENGTH), starts, ends


def chunks(texts: Sequence[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many code points in all; a longer text is a run of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(texts):
        yield at, len(texts)


def words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, the offset of each text's first word (one more than texts), and the words' starts and ends.

    Starts and ends count code points in the texts joined with one separator. Null is an empty text.
    """
    joined = "\n".join(t or "" for t in texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, starts, ends = _hash_chars(chars)
    begins = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins), starts, ends


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)
