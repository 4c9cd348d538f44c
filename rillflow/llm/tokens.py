"""Byte-level BPE ids of many texts at once, by the `tokenizers` library.

The library encodes each distinct pre-token once; numpy finds the pre-tokens of
a whole chunk of texts and strings the remembered ids together. Special tokens'
strings in a text are ordinary text. ``Encoder.encode`` gives what
``Tokenizer.encode(text, add_special_tokens=False).ids`` gives.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .common import _BASE, _INVERSE, _power, mix

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_LETTER, _NUMBER, _BLANK, _OTHER, _STOP = 1, 2, 3, 0, 4
_END = "\U0010ffff"


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = _BLANK
    return table


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(starts, ends, text index, hash) of the pre-tokens, and the joined texts.

    Runs of letters, numbers, blanks and other characters are pre-tokens; a blank
    directly before a run of another kind belongs to that run, and an apostrophe
    that starts a pre-token takes a contraction's letters with it.
    """
    joined = _END.join(texts) + _END
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[stops] = _STOP
    begin = np.empty(len(code), bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[stops] = True
    begin[stops[:-1] + 1] = True
    # the last of several blanks before a run stands alone, or joins it if it is U+0020
    last = np.flatnonzero((kind[:-1] == _BLANK) & begin[1:] & (kind[1:] != _STOP))
    begin[last] = True
    begin[last[code[last] == 0x20] + 1] = False
    quote = np.flatnonzero((code == 0x27) & begin)
    quote = quote[quote + 1 < len(code)]
    quote = quote[kind[quote + 1] == _LETTER]
    if len(quote):
        one = code[quote + 1]
        two = code[np.minimum(quote + 2, len(code) - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        rest = quote + size
        begin[rest[kind[rest] == _LETTER]] = True
    bounds = np.flatnonzero(begin)
    starts, ends = bounds[:-1], bounds[1:]
    real = kind[starts] != _STOP
    starts, ends = starts[real], ends[real]
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(code)), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(code))[starts])
    return starts, ends, np.searchsorted(stops, starts), h, joined


class Encoder:
    """Ids of texts; remembers at most ``room`` pre-tokens (a matter of speed only)."""

    def __init__(self, path: str, room: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.room = room
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, strings: list[str]) -> None:
        if len(self.known) + len(hashes) > self.room:
            self._forget()
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if not any(texts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        starts, ends, text, h, joined = pretokens(texts)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any() and len(self.known) + int(new.sum()) > self.room:
            self._forget()
            new[:] = True
        if new.any():
            self._learn(distinct[new], [joined[starts[i] : ends[i]] for i in first[new]])
        where = np.searchsorted(self.known, distinct)[back]
        size, at = self.size[where], self.at[where]
        begin = np.cumsum(size) - size
        ids = self.flat[np.repeat(at - begin, size) + np.arange(int(size.sum()))]
        return ids, np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each process, so that a reused worker keeps what it knows."""
    return Encoder(path)
