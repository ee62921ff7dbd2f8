"""Word shingles of texts, hashed and laid out in flat numpy arrays."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

from .common import MIX3, mix, starts

_WORD = re.compile(r"[^\W_]+")
_CACHE_MOST = 2_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the composed, lower-cased text.

    The rest of the cleaning only moves blanks and line ends, which separate words either way.
    """
    return _WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the offsets of the texts."""
    every: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        counts[i] = len(w)
        every += w
    return np.fromiter(map(_hashes.__getitem__, every), dtype=np.uint64, count=len(every)), starts(counts)


def shingle_hashes(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within a text, in order, and offsets; shorter texts have none."""
    n = np.maximum(np.diff(at) - (k - 1), 0)
    off = starts(n)
    first = np.repeat(at[:-1] - off[:-1], n) + np.arange(off[-1])
    s = np.zeros(off[-1], dtype=np.uint64)
    for i in range(k):
        s = (s ^ h[first + i]) * MIX3
        s ^= s >> np.uint64(31)
    return mix(s), off


def distinct_sorted(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repetitions."""
    s = s.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = s[1:] != s[:-1]
    keep[off[:-1][off[:-1] < len(s)]] = True
    return s[keep], starts(np.add.reduceat(keep, off[:-1][np.diff(off) > 0]).astype(np.int64) if len(s) else np.zeros(0, np.int64)) if (np.diff(off) > 0).all() else _offsets(keep, off)


def _offsets(keep: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(keep)])
    return c[off]


def minhash(s: np.ndarray, off: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k signature coordinates (32 bits) of each non-empty set."""
    mul = np.random.default_rng(seed).integers(1, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(off) - 1, k), dtype=np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    m, t = np.empty_like(x), np.empty_like(x)
    for c in range(k):
        np.multiply(x, mul[c], out=m)
        np.right_shift(m, np.uint32(15), out=t)
        np.bitwise_xor(m, t, out=m)
        np.multiply(m, np.uint32(0x85EBCA6B), out=m)
        np.right_shift(m, np.uint32(13), out=t)
        np.bitwise_xor(m, t, out=m)
        out[:, c] = np.minimum.reduceat(m, off[:-1])
    return out


def half_bytes(mh: np.ndarray) -> np.ndarray:
    """Signature with the low half-byte of each coordinate, two to a byte."""
    low = (mh & 15).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def winnow(s: np.ndarray, off: np.ndarray, w: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed fingerprints: the least hash of every window of w successive hashes, each selected place once.

    Texts of at most ``short`` hashes keep all of them.  Returns values, their places in the text, and offsets.
    """
    n = np.diff(off)
    total = int(off[-1])
    place = np.arange(total) - np.repeat(off[:-1], n)
    chosen = np.repeat(n <= short, n)
    if total >= w:
        from numpy.lib.stride_tricks import sliding_window_view

        best = sliding_window_view(s, w).argmin(axis=1) + np.arange(total - w + 1)
        inside = (place + w <= np.repeat(n, n))[: total - w + 1]
        chosen[best[inside]] = True
    return s[chosen], place[chosen], _offsets(chosen, off)

