"""Word sequences of whole texts as 64-bit fingerprints, by vectorised scans."""

from __future__ import annotations

import numpy as np

from .textscan import PrefixHash, word_bounds

_byte = np.arange(256)
#: ASCII letters lower-cased, other bytes as they are.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes other than the space and \\x09-\\x0D.
NOT_SPACE = ~((_byte == 0x20) | (_byte >= 0x09) & (_byte <= 0x0D))
#: Digits, lower-case letters and everything past ASCII.
ALPHANUMERIC = (_byte >= 0x30) & (_byte <= 0x39) | (_byte >= 0x61) & (_byte <= 0x7A) | (_byte >= 0x80)


def word_slices(data: np.ndarray, off: np.ndarray, in_word: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, fingerprints of all words, their starts and ends, offsets of the texts into them); ``in_word`` is a table of bytes, read after lower-casing."""
    low = LOWER[data]
    starts, ends = word_bounds(in_word[low], off)
    prints = PrefixHash(low, which).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return low, prints, starts, ends, np.searchsorted(starts, off)


def word_prints(data: np.ndarray, off: np.ndarray, in_word: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words, offsets of the texts into them)."""
    _, prints, _, _, upto = word_slices(data, off, in_word, which)
    return prints, upto
