"""Vectorised hashing, windows and winnowing over word or byte sequences (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: Random 64-bit value of each byte, multiplier of each doubling step.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
STEP = _RNG.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
BASE = int(_RNG.integers(1, 1 << 62)) * 8 + 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE % (1 << 64), pow(BASE, -1, 1 << 64))):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than white space."""
    edge = np.empty(len(buf) + 2, np.int8)
    edge[0] = edge[-1] = 1
    edge[1:-1] = SPACE[buf]
    at = np.flatnonzero(np.diff(edge))
    return at[0::2], at[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    if len(buf) > block:  # word by word range, so memory beside the hashes does not grow with the text
        cut = np.unique(np.concatenate(([0], np.searchsorted(starts, np.arange(block, len(buf), block)), [len(starts)])))
        return np.concatenate([word_hashes(buf[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], 1 << 62) for a, b in zip(cut[:-1], cut[1:])] or [np.zeros(0, U)])
    p, inv = powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * p[:-1], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(U))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k elements, by doubling; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at, a, size, step = None, 0, h, 1, 0
    while True:
        if k & size:
            part = a[at : at + n]
            out = part.copy() if out is None else out * STEP[32 + step] + part
            at += size
        if 2 * size > k:
            return mix(out)
        a = a[:-size] * STEP[step] + a[size:]
        size, step = 2 * size, step + 1


def sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        a = f(a[:-s], a[s:])
        s *= 2
    return f(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


def winnow(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of w grams: positions p, and the first and last window that picks each p.

    A window picks the leftmost of its least grams, so equal windows pick the same gram at the same offset.
    """
    n = len(g)
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none
    m = sliding(g, w, np.minimum)
    padded = np.zeros(len(m) + 2 * (w - 1), U)
    padded[w - 1 : w - 1 + len(m)] = m
    c = np.flatnonzero(g == sliding(padded, w, np.maximum))
    v = g[c]
    lo, hi = np.maximum(c - w + 1, 0), np.minimum(c, n - w)
    act, d = np.arange(1, len(c)), 1
    while act.size:
        near = c[act - d] > c[act] - w
        hit = near & (v[act - d] <= v[act])
        lo[act[hit]] = np.maximum(lo[act[hit]], c[act[hit] - d] + 1)
        act, d = act[near & ~hit], d + 1
        act = act[act >= d]
    act, d = np.arange(len(c) - 1), 1
    while act.size:
        near = c[act + d] < c[act] + w
        hit = near & (v[act + d] < v[act])
        hi[act[hit]] = np.minimum(hi[act[hit]], c[act[hit] + d] - w)
        act, d = act[near & ~hit], d + 1
        act = act[act < len(c) - d]
    ok = lo <= hi
    return c[ok], lo[ok], hi[ok]


def joined(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one space after each, and each text's start and end in it."""
    size = np.fromiter((len(v) if v else 0 for v in values), np.int64, len(values))
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    buf = np.frombuffer(b" ".join([v or b"" for v in values] + [b""]), np.uint8)
    return buf, start, start + size


class Words:
    """The words of a run of texts: bounds in ``buf``, hashes, and the first and last word of each text."""

    def __init__(self, values: list[bytes | None], lower: bool = False):
        if lower:
            values = [v.translate(LOWER) if v else v for v in values]
        self.buf, self.start, self.end = joined(values)
        self.ws, self.we = word_bounds(self.buf)
        self.hash = word_hashes(self.buf, self.ws, self.we)
        self.first = np.searchsorted(self.ws, self.start)
        self.last = np.searchsorted(self.ws, self.end)
