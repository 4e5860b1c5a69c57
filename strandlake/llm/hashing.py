"""Vectorised 64-bit hashes of byte spans and of word windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Odd 64-bit multipliers for the byte and the word polynomial, and a window finaliser's three.
BYTE_BASE = np.uint64(0x9E6C63D0876A9A35)
WORD_BASE = np.uint64(0xD1342543DE82EF95)
WORD_INVERSE = np.uint64(pow(int(WORD_BASE), -1, 1 << 64))
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers_to(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers_to(int(base), max(6, int(n - 1).bit_length()))[:n]


def ragged_take(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate flat[at[r]:at[r+1]] for each r of ``rows``; also where each begins, and the total."""
    n = (at[1:] - at[:-1])[rows]
    ends = np.append(0, np.cumsum(n))
    index = np.repeat(at[rows] - ends[:-1], n) + np.arange(ends[-1])
    return flat[index], ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 150_000) -> np.ndarray:
    """A 64-bit hash of each of the ascending, non-empty byte spans, in slices of about ``step`` bytes."""
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    total = np.append(0, np.cumsum(size))
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], step)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        n = size[a:b]
        begin = total[a:b] - total[a]
        inside = np.arange(total[b] - total[a]) - np.repeat(begin, n)
        value = buf[inside + np.repeat(starts[a:b], n)].astype(np.uint64) + np.uint64(1)
        value *= powers(BYTE_BASE, int(n.max()))[inside]
        out[a:b] = mix(np.add.reduceat(value, begin))
    return out


class Words:
    """Words (maximal runs without blank, tab, or the other ASCII line and page breaks) of many texts."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(raw, np.uint8)
        data = _LOWER[self.buf] if lower else self.buf
        edge = np.diff(_BLANK[data].view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_at = np.append(0, np.cumsum(size))
        #: the first word of each text, and the number of words
        self.at = np.searchsorted(self.starts, self.text_at)
        self.hashes = span_hashes(data, self.starts, self.ends)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of each run of ``width`` words within one text; and each one's first word."""
        n = len(self.hashes)
        if n < width:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = np.ones(n - width + 1, bool)
        last = self.at[1:-1]  # windows that begin less than width words before a text's first word cross into it
        for back in range(1, width):
            k = last - back
            inside[k[(k >= 0) & (k < len(inside))]] = False
        first = np.flatnonzero(inside)
        prefix = np.empty(n + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(self.hashes * powers(WORD_BASE, n), dtype=np.uint64, out=prefix[1:])
        # prefix[i] sums hash[j] * base**j: a window's difference times base**-first is a function of its words alone
        return mix((prefix[first + width] - prefix[first]) * powers(WORD_INVERSE, n)[first]), first
