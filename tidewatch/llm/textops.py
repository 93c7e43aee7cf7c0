"""Vectorised word and hash kernels over the UTF-8 bytes of many documents at once."""

from __future__ import annotations

import hashlib

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}

WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


#: One 64-bit value for each byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
#: Others, for a second hash that owes nothing to the first.
BYTE2 = mix((np.arange(256, dtype=np.uint64) + np.uint64(1001)) * _GOLD) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n + 1:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("p", _BASE), ("q", _INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:  # doubling
                step = np.uint64(pow(base, have, 1 << 64))
                take = min(have, size - have)
                np.multiply(out[:take], step, out=out[have : have + take])
                have += take
            _pow[key] = out
    return _pow["p"], _pow["q"]


class Prefix:
    """Rolling hash of any stretch of a byte array, or of an array of 64-bit values, from prefix sums modulo 2**64.

    Not for long stretches of few different values: from about a thousand on, there are some (Thue-Morse words) that
    collide under any odd base. Words and lines take chain() or identities().
    """

    def __init__(self, values: np.ndarray):
        v = BYTE[values] if values.dtype == np.uint8 else values
        p, self._q = _powers(len(v))
        self._p = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * p[: len(v)], out=self._p[1:])

    def of(self, start: np.ndarray, end: np.ndarray, final: bool = True) -> np.ndarray:
        h = (self._p[end] - self._p[start]) * self._q[start]
        return mix(h + (end - start).astype(np.uint64) * _GOLD) if final else h


#: Longer stretches are hashed by BLAKE2b, one at a time.
LONG = 256


def chain(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: its length and its blocks of eight bytes, each mixed into what came before."""
    size = end - start
    h = mix((size.astype(np.uint64) + np.uint64(1)) * _GOLD)
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    todo, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(todo):
        left = size[todo] - done
        block = eight[start[todo] + done]
        part = left < 8
        block[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        h[todo] = mix(h[todo] ^ block) + _GOLD
        done += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(size > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of these sizes at `a` and at `b` hold the same bytes."""
    out = np.ones(len(a), bool)
    lo = 0
    ends = np.cumsum(size)
    while lo < len(a):  # some megabytes at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
        n = size[lo:hi]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = raw[np.repeat(a[lo:hi], n) + step] != raw[np.repeat(b[lo:hi], n) + step]
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), weights=differ, minlength=hi - lo) == 0
        lo = hi
    return out


def identities(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit values that are equal for equal stretches only: hashes whose stretches are compared, or else their numbers."""
    h, size = chain(raw, start, end), end - start
    o = np.argsort(h, kind="stable")
    twin = np.flatnonzero(h[o[1:]] == h[o[:-1]])
    a, b = o[twin], o[twin + 1]
    if (size[a] == size[b]).all() and same_bytes(raw, start[a], start[b], size[a]).all():
        return h
    number: dict[bytes, int] = {}
    return mix(np.array([number.setdefault(raw[i:j].tobytes(), len(number)) for i, j in zip(start, end)], np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of bytes other than space and \\t..\\r."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = ~WS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word never crosses documents
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = on[:-1]
    starts = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = on[1:]
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, doc


def runs_of(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of bytes of one kind other than 0."""
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True  # a run never crosses documents
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    some = kind[start] > 0
    return start[some], end[some], np.searchsorted(offsets, start[some], "right") - 1


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every n-word window that lies in one document; h: hashes of words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: m] == doc[n - 1 :])
    out = Prefix(h).of(at, at + n)
    return at, out


def repeated(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same hash occurs twice or more in the same document."""
    return _runs(h, doc)[0]


def later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same hash occurred before in the same document."""
    return _runs(h, doc)[1]


def _runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, after = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) < 2:
        return both, after
    key = h ^ mix(doc.astype(np.uint64) + _GOLD)
    o = np.argsort(key, kind="stable")
    s = key[o]
    same = s[1:] == s[:-1]
    after[o[1:][same]] = True
    both[o[1:][same]] = True
    both[o[:-1][same]] = True
    return both, after


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the items inside any window of n that starts at one of `at`."""
    d = np.bincount(at, minlength=size + 1).astype(np.int32)
    d -= np.bincount(np.minimum(at + n, size), minlength=size + 1).astype(np.int32)
    return np.cumsum(d[:-1]) > 0
