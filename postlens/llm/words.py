"""Words, word hashes and word shingles of many texts at once, as numpy arrays.

A word is a maximal run of characters other than space, tab, newline, vertical tab, form
feed and carriage return. Words are hashed by a polynomial over random byte values modulo
2**64 followed by a bijective mix; runs of words by a polynomial over the word hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, … modulo 2**64, ``n`` of them; tables are made in sizes of 2**k."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


@lru_cache(maxsize=4)
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(values[s + j] * base**j) for each span [s, e), by differences of one running sum."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(_inverse(base), n + 1)[starts]


class Words:
    """The words of a run of texts: ``hash`` per word, and ``first`` with the word index at
    which each text starts (one entry more than there are texts)."""

    def __init__(self, texts: pa.Array, lower: bool = False, keep_bytes: bool = False):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = raw.to_pybytes()[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else b""
        if lower:
            data = data.translate(_LOWER)
        at = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        b = np.frombuffer(data, np.uint8)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(b))]
        begins[cuts] = word[cuts]
        ends[cuts - 1] = word[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, at)
        self.bytes = data if keep_bytes else None
        length = (self.ends - self.starts).astype(np.uint64)
        self.hash = mix(span_hashes(_byte_values(7)[b], self.starts, self.ends, 0x5851F42D4C957F2D) + length * _ODD)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` consecutive words of one text, with the text of each. The
        i-th entry starts at word ``i`` where the second array is not -1."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        starts = np.arange(n - width + 1)
        owner = np.repeat(np.arange(len(self)), self.counts())
        value = mix(span_hashes(self.hash, starts, starts + width, base))
        return value, np.where(owner[: n - width + 1] == owner[width - 1 :], owner[: n - width + 1], -1)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers byte plane by byte plane: equal high bytes then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()
