"""Numpy kernels over many texts at once: word boundaries, word hashes, window hashes.

A slice of texts is joined by line feeds, so no word crosses a text. All hashes are 64-bit
polynomials modulo 2**64 with odd bases (so that a prefix sum can be shifted back by the inverse
power), mixed by a xor-shift-multiply finalizer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
NODE_BASE = 0xAF251AF3B0F025B5
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    had = _powers.get(base)
    if had is None or len(had[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        had = _powers[base] = (pair[0], pair[1])
    return had


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0x2545F4914F6CDD1D))


def spans_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, end and hash of every word, first word of each text with the total appended)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # pieces end between words
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK, "right")))
        a, b = starts[k], ends[last - 1]
        hashes[k:last] = span_hashes(raw[a:b].astype(np.uint64) + U(1), starts[k:last] - a, ends[k:last] - a, BYTE_BASE)
        k = last
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return raw, starts, ends, hashes, np.searchsorted(starts, offsets)


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text with the total appended)."""
    return spans_of(texts, lower)[3:]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each span, one span after the other."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def window_hashes(words: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of words[i:i+size] for every i that has as many words; texts aren't told apart."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(words, starts, starts + size, base)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def whole_windows(bounds: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that lie in one text."""
    lengths = np.maximum(np.diff(bounds) - size + 1, 0)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(bounds[:-1] - before, lengths)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words from one of `starts`."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost smallest of values[i:i+size] for each whole window."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < size:
        step = min(span, size - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[:n]
