"""Splitting text as public_tokenizers.PATTERN does, vectorised over code points.

The pattern takes contractions, runs of letters, of numbers or of other signs (each with one blank before it) and white
space. Runs of one class decide where pieces start, so no regular expression has to walk the text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd

from fluxframe.llm.arrays import RangeHash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

# Letters and numbers that Unicode 16 has added (first, last, class), for a Python whose tables are older.
UNICODE_16 = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            out[c] = k
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = SPACE
    if unicodedata.unidata_version < "16":
        for first, last, k in UNICODE_16:
            out[first : last + 1] = k
    return out


def pieces(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows start, ascending; offsets are the rows' limits in points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(run)
    ends = np.append(begins[1:], n)
    white = kind[begins] == SPACE
    last_of_row = first[ends]
    start = np.zeros(n + 1, bool)
    # A run that is no white space starts a piece, at the blank before it if there is one.
    solid = begins[~white]
    blank = np.zeros(len(solid), bool)
    has = (solid > 0) & ~first[solid]
    blank[has] = points[solid[has] - 1] == 0x20
    start[solid - blank] = True
    # White space at the end of a row is one piece; elsewhere its last character stands alone or goes to the next piece.
    start[begins[white & last_of_row]] = True
    inner = white & ~last_of_row
    long = inner & (ends - begins > 1)
    start[begins[long]] = True
    start[ends[inner] - 1] = True
    # Contractions: a lone apostrophe with no blank before it takes the letters after it.
    lone = (kind[begins] == OTHER) & (ends - begins == 1) & (points[begins] == 0x27)
    at = begins[lone]
    at = at[(at == 0) | first[at] | (points[np.maximum(at - 1, 0)] != 0x20)]
    at = at[(at + 1 < n) & ~first[np.minimum(at + 1, n)]]
    if len(at):
        one = points[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        can = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        two = np.where(can, points[np.minimum(at + 2, n - 1)], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 2), (pair, 3)):
            start[at[hit] + 1] = False
            after = at[hit] + size
            start[after[(after < n) & (kind[np.minimum(after, n - 1)] != SPACE)]] = True
    return np.flatnonzero(start[:n])


def _same(a: np.ndarray, a_first: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which ranges of a hold what the ranges of b hold."""
    n = a_end - a_first
    out = n == b_end - b_first
    n = np.where(out, n, 0)
    upto = np.cumsum(n)
    step = np.arange(upto[-1] if len(upto) else 0)
    differ = a[np.repeat(a_first - (upto - n), n) + step] != b[np.repeat(b_first - (upto - n), n) + step]
    out[np.searchsorted(upto, np.flatnonzero(differ), side="right")] = False
    return out


def _same(a: np.ndarray, a_first: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which ranges of a hold what the ranges of b hold."""
    n = a_end - a_first
    out = n == b_end - b_first
    n = np.where(out, n, 0)
    upto = np.cumsum(n)
    step = np.arange(upto[-1] if len(upto) else 0)
    differ = a[np.repeat(a_first - (upto - n), n) + step] != b[np.repeat(b_first - (upto - n), n) + step]
    out[np.searchsorted(upto, np.flatnonzero(differ), side="right")] = False
    return out


class PieceIds:
    """The ids of pieces already met, found by hash and compared in full, in sorted arrays that are emptied when full.

    encode takes distinct pieces and returns the ids of all of them in one array, and each piece's number of ids.
    """

    #: Code points of pieces that are kept; longer pieces are met too seldom to be.
    POINTS, LONGEST = 1 << 23, 1 << 12

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.points, self.limits = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, counts = self.encode(pieces)
        slots = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(keys))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.points = np.concatenate([self.points, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)])
        self.limits = np.concatenate([self.limits, self.limits[-1] + np.cumsum([len(p) for p in pieces])])

    def _one_by_one(self, texts: list[str], joined: str, start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the hashes: all distinct pieces are encoded anew."""
        names: dict[str, int] = {}
        number = np.array([names.setdefault(joined[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        ids, counts = self.encode(list(names))
        return self._laid_out(ids.astype(np.uint32), np.append(0, np.cumsum(counts)), number, start, offsets)

    @staticmethod
    def _laid_out(ids: np.ndarray, ends: np.ndarray, slot: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = ends[slot]
        counts = ends[slot + 1] - first
        upto = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(counts, out=upto[1:])
        return ids[np.repeat(first - upto[:-1], counts) + np.arange(upto[-1])], upto[np.searchsorted(start, offsets)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the texts' limits in them."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        start = pieces(points, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        end = np.append(start[1:], len(points))
        number, keys = pd.factorize(RangeHash(points)(start, end))
        some = np.empty(len(keys), np.int64)
        some[number] = np.arange(len(number))
        one = some[number]
        if (end - start > self.LONGEST).any() or not _same(points, start, end, points, start[one], end[one]).all():
            return self._one_by_one(texts, joined, start, end, offsets)
        new = self._missing(keys)
        size = int((end - start)[some[new]].sum())
        if len(new) and (len(self.keys) + len(new) > self.most or len(self.points) + size > self.POINTS):
            self.clear()
            new = np.arange(len(keys))
        if len(new):
            a, b = start[some[new]].tolist(), end[some[new]].tolist()
            self._learn(keys[new], [joined[x:y] for x, y in zip(a, b, strict=True)])
        slot = self.slots[np.searchsorted(self.keys, keys)]
        if not _same(points, start[some], end[some], self.points, self.limits[slot], self.limits[slot + 1]).all():
            return self._one_by_one(texts, joined, start, end, offsets)
        return self._laid_out(self.ids, self.ends, slot[number], start, offsets)

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)
