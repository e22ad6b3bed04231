"""Vectorised scans of UTF-8 text: prefix hashes, word bounds, sliding minima."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: Hashes are polynomials modulo this prime at a fixed random point of large order; their values have 61 bits.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
#: Two independent points, for a pair of 61-bit values where one isn't enough.
POINTS = tuple(int(x) for x in _RNG.integers(1 << 59, PRIME, 2))
#: Items that one difference of the byte sums may span without leaving 64 bits.
_SPAN = 1 << 24
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A random odd 64-bit value for each byte and an odd multiplier, for rolling marks modulo 2**64. These choose places; nothing is equal because its marks are.
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = int(_RNG.integers(1 << 62, 1 << 63)) | 5
_MARK_POW: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``a * (high * 2**31 + low)`` modulo the prime, for reduced factors."""
    top, rest = a >> np.uint64(31), a & _LOW31
    low, high = low.astype(np.uint64), high.astype(np.uint64)
    middle = rest * high + top * low
    return _reduced(top * high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + rest * low)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 31 and high 30 bits of the first ``n`` powers, remembered and doubled as needed."""
    low, high = _POW.get(base, (np.ones(1, np.uint32), np.zeros(1, np.uint32)))
    while len(low) < n:
        step = np.uint64(pow(base, len(low), PRIME))
        more = _times(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(31), step & _LOW31, step >> np.uint64(31))
        low, high = np.concatenate([low, (more & _LOW31).astype(np.uint32)]), np.concatenate([high, (more >> np.uint64(31)).astype(np.uint32)])
        _POW[base] = low, high
    return low[:n], high[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """One-to-one finaliser of a 64-bit hash (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class PrefixHash:
    """Hashes of any slices of a sequence of bytes or of 64-bit items: sums of (item + 1) times the powers of a point, modulo a prime.

    Two different slices of n items collide with a chance of at most n / 2**61. ``which`` chooses one of two independent points.
    """

    def __init__(self, items: np.ndarray, which: int = 0):
        self.n, self.point = len(items), POINTS[which]
        low, high = _powers(self.point, self.n)
        self.low, self.high = np.zeros(self.n + 1, np.uint64), np.zeros(self.n + 1, np.uint64)
        if items.dtype == np.uint8:
            values = items.astype(np.uint64) + np.uint64(1)
            np.cumsum(values * low, out=self.low[1:])
            np.cumsum(values * high, out=self.high[1:])
        else:
            terms = _times(_reduced(items + np.uint64(1)), low, high)
            np.cumsum(terms & _LOW31, out=self.low[1:])
            np.cumsum(terms >> np.uint64(31), out=self.high[1:])

    def _raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = _reduced(self.high[ends] - self.high[starts])
        high = ((high << np.uint64(31)) & _P) | (high >> np.uint64(30))
        low, up = _powers(pow(self.point, -1, PRIME), self.n + 1)
        return _times(_reduced(high + _reduced(self.low[ends] - self.low[starts])), low[starts], up[starts])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self._raw(starts, ends)
        for k in np.flatnonzero(ends - starts > _SPAN).tolist():
            parts = np.arange(int(starts[k]), int(ends[k]), _SPAN)
            values = self._raw(parts, np.minimum(parts + _SPAN, int(ends[k]))).tolist()
            h[k] = sum(v * pow(self.point, p - int(starts[k]), PRIME) for v, p in zip(values, parts.tolist(), strict=True)) % PRIME
        return mix(h)


def rolling_marks(data: np.ndarray, width: int) -> np.ndarray:
    """A mark of 64 bits for each slice of ``width`` bytes, equal for equal slices (and now and then for others)."""
    have = []
    for base in (_MULT, pow(_MULT, -1, 1 << 64)):
        p = _MARK_POW.get(base)
        if p is None or len(p) <= len(data):
            p = np.full(max(1 << 16, 1 << len(data).bit_length()), base, np.uint64)
            p[0] = 1
            _MARK_POW[base] = p = np.multiply.accumulate(p)
        have.append(p)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * have[0][: len(data)], out=sums[1:])
    h = sums[width:] - sums[:-width]
    h *= have[1][: len(h)]
    return mix(h)


def leading_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each slice as a number, zeros beyond its end; with its size it is the whole of a slice of at most eight bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))[starts]
    return words & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(sizes, 8).astype(np.uint64)))


def same_slices(data: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the bytes of each slice equal those of ``other`` from its place, byte by byte."""
    if not len(starts):
        return True
    if not (leading_words(data, starts, sizes) == leading_words(other, places, sizes)).all():
        return False
    long = np.flatnonzero(sizes > 8)
    run, at = spread(sizes[long])
    return bool((data[starts[long][run] + at] == other[places[long][run] + at]).all())


def word_bounds(in_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross the texts' offsets."""
    n = len(in_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = in_word.copy()
    first[1:] &= ~in_word[:-1]
    last = in_word.copy()
    last[:-1] &= ~in_word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = in_word[cuts]
    last[cuts - 1] = in_word[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values (block prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: each element's run and its place in it."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
