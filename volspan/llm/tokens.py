"""Byte-level BPE encoding of whole texts by the tokenizers library, with each distinct chunk encoded once per worker.

A text is cut where the pre-tokenizer cuts in any case: before a space that a visible character follows, before ``.`` or ``,`` after an ASCII letter or digit,
and around a single newline between visible ASCII characters. The library encodes a chunk exactly as it encodes it inside its text, so the ids of a text are the
joined ids of its chunks. A bounded table of chunks spares most of the work; unseen chunks go to the library in joined blocks. Chunks are found by fingerprint and then compared
byte by byte; a step in which two chunks share a fingerprint goes to the library text by text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from .textscan import PrefixHash, same_slices, spread

#: Distinct chunks that a worker remembers; beyond that it starts afresh.
REMEMBERED = 700_000
_BLOCK = 1 << 18

_SPACE, _DOT, _COMMA, _NEWLINE = b" .,\n"
_byte = np.arange(256)
_VISIBLE = (_byte > 0x20) & (_byte < 0x7F)
#: Visible ASCII, or the lead byte of a two-byte character past the Latin-1 controls and spaces.
_VISIBLE_NEXT = _VISIBLE | (_byte >= 0xC3) & (_byte <= 0xDF)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of text that each id stands for
        for token, number in vocab.items():
            self.width[number] = len(token)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not kind.get("normalizer")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.text_at = np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)

    def _texts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of each text by itself."""
        return self._library([data[s:e].tobytes().decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, newline: bool) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per piece) of pieces that may stand one after another, with a newline between them if asked for."""
        gap = int(newline)
        size = ends - starts
        total = np.cumsum(size + gap)
        flat, counts = [], []
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _BLOCK, side="right")))
            run, place = spread(size[lo:hi] + gap)
            at = starts[lo:hi][run] + place
            block = data[np.minimum(at, len(data) - 1)]
            if newline:
                block[place == size[lo:hi][run]] = _NEWLINE
                block = block[:-1]
            ids = self._library([block.tobytes().decode("utf-8")])[0]
            stop = np.cumsum(size[lo:hi] + gap) - gap
            upto = np.cumsum(self.width[ids])
            last = np.searchsorted(upto, stop)
            first = np.searchsorted(upto, stop - size[lo:hi], side="right")
            if not ((upto[last] == stop).all() and (upto[first] - self.width[ids[first]] == stop - size[lo:hi]).all()):
                raise ValueError("a chunk's ids don't end at its last byte")
            n = last - first + 1
            run, place = spread(n)
            flat.append(ids[first[run] + place])
            counts.append(n)
            lo = hi
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        head, tail = data[starts], data[ends - 1]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        spaced = (head == _SPACE) & (ends - starts > 1) & _VISIBLE_NEXT[second]
        plain = _VISIBLE[head] & _VISIBLE[tail] & ~spaced
        rest = ~spaced & ~plain
        odd = self._texts(data, starts[rest], ends[rest])
        parts = [
            (keys[spaced], *self._joined(data, starts[spaced], ends[spaced], False)),
            (keys[plain], *self._joined(data, starts[plain], ends[plain], True)),
            (keys[rest], np.concatenate([np.zeros(0, np.uint32), *odd]), np.array([len(x) for x in odd], np.int64)),
        ]
        size = np.concatenate([x[2] for x in parts])
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *(x[1] for x in parts)])
        groups = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(plain), np.flatnonzero(rest)])
        wide = (ends - starts)[groups]
        run, place = spread(wide)
        text_at = len(self.text) + np.cumsum(wide) - wide
        self.text = np.concatenate([self.text, data[starts[groups][run] + place]])
        keys, at, size = np.concatenate([self.keys, *(x[0] for x in parts)]), np.append(self.at, at), np.append(self.size, size)
        text_at, text_size = np.append(self.text_at, text_at), np.append(self.text_size, wide)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size, self.text_at, self.text_size = keys[order], at[order], size[order], text_at[order], text_size[order]

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        before, here, after = data[:-2], data[1:-1], data[2:]
        seen_next = _VISIBLE_NEXT[after]
        cut[1:-2] = (here == _SPACE) & seen_next | ((here == _DOT) | (here == _COMMA)) & _ALNUM[before]
        single = np.flatnonzero((here == _NEWLINE) & _VISIBLE[before] & seen_next) + 1
        cut[single] = True
        cut[single + 1] = True
        cut[off[1:][off[1:] > 0] - 1] = False  # what comes next is another text
        cut[off[:-1]] = True
        return np.flatnonzero(cut[: len(data)])

    @staticmethod
    def prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return PrefixHash(data).of(starts, ends)

    def _whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self._texts(data, off[:-1], off[1:])
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets into them) of the texts in ``data``."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if not self.chunked or len(data) < 3:
            return self._whole(data, off)
        starts = self._chunks(data, off)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(self.prints(data, starts, ends), return_index=True, return_inverse=True)
        wide = ends - starts
        if not ((wide == wide[first][which]).all() and same_slices(data, starts, data, starts[first][which], wide)):
            return self._whole(data, off)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
            row, mine = place[known], first[known]
            if not ((wide[mine] == self.text_size[row]).all() and same_slices(data, starts[mine], self.text, self.text_at[row], wide[mine])):
                return self._whole(data, off)
        if len(self.keys) + len(keys) - known.sum() > REMEMBERED:
            self.forget()
            known[:] = False
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(data, keys[new], starts[first[new]], ends[first[new]])
        place = np.searchsorted(self.keys, keys)
        size = self.size[place][which]
        run, offset = spread(size)
        ids = self.ids[self.at[place][which][run] + offset]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, upto[np.searchsorted(starts, off)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
