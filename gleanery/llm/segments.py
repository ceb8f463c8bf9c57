"""Vectorised segmentation of UTF-8 bytes, segment hashes, and a bounded cache of what was computed for a segment.

A text is cut at places where an encoder can never join both sides, each distinct segment is encoded once, and the
text's ids are gathered with numpy. Places where that is not certain are not cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gleanery.llm.common import kept

#: Byte classes: a byte of none of the others, letter, space, newline, ASCII punctuation, digit, apostrophe.
OTHER, LETTER, SPACE, NEWLINE, PUNCT, DIGIT, APOSTROPHE = range(7)
_MULT = 0x9E3779B97F4A7C15 | 1
_ALL = (1 << 64) - 1


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(33, 127):
        t[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else PUNCT
    t[32], t[10], t[39] = SPACE, NEWLINE, APOSTROPHE
    return t


def classes(buf: np.ndarray) -> np.ndarray:
    """Class of each byte; both bytes of the letters U+00C0 to U+00FF count as LETTER, other non-ASCII as OTHER."""
    cls = kept("byte-classes", _class_table)[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    if len(lead):
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        cls[lead] = LETTER
        cls[lead + 1] = LETTER
    return cls


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = kept("powers", dict)
    if have.get("n", 0) < n:
        n = max(n, 1 << 21) + 1
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            have[name] = np.multiply.accumulate(a)
        have["n"] = n
    return have["up"], have["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hash of each buf[start:end], the same wherever the bytes stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    codes = kept(("codes", seed), lambda: np.random.default_rng(seed).integers(0, _ALL, 256, np.uint64, endpoint=True))
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def cuts_to_segments(cut: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the segments that begin where `cut` is set and at each text's start."""
    n = len(cut)
    cut[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)[: len(starts)]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of all the runs [start, start + len), one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lens)


class SegmentCache:
    """Rows of int32 values by 64-bit segment hash. Beyond `most` rows it starts anew, so memory is bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.at, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), 0
        self.flat = np.zeros(1 << 16, np.int32)

    def _find(self, u: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(u), -1, np.int64)
        p = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
        return np.where(self.keys[p] == u, self.rows[p], -1)

    def get(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all segments in order, and how many each segment has."""
        h = segment_hashes(buf, starts, ends)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        row = self._find(u)
        new = np.flatnonzero(row < 0)
        if len(new) and len(self.keys) + len(new) > self.most:
            self.clear()
            row[:], new = -1, np.arange(len(u))
        if len(new):
            raw = buf.tobytes()
            made = self.encode([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            lens = np.fromiter(map(len, made), np.int64, len(made))
            need = self.used + int(lens.sum())
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(need - len(self.flat), len(self.flat)), np.int32)])
            self.flat[self.used : need] = np.fromiter((x for m in made for x in m), np.int32, need - self.used)
            row[new] = len(self.at) - 1 + np.arange(len(new))
            self.at = np.append(self.at, self.used + np.cumsum(lens))
            self.used = need
            where = np.searchsorted(self.keys, u[new])
            self.keys, self.rows = np.insert(self.keys, where, u[new]), np.insert(self.rows, where, row[new])
        row = row[back]
        lens = self.at[row + 1] - self.at[row]
        return self.flat[ragged(self.at[row], lens)], lens
