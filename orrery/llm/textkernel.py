"""Words and their hashes for whole Arrow batches of text, without a Python loop over words.

A word's hash is a polynomial over per-byte random values, taken from one prefix sum over the batch,
so that any substring's hash costs one subtraction and one multiplication. All arithmetic is modulo
2**64 and is followed by a mixing step; equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are handled in runs of about so many bytes, which bounds a task's temporary arrays.
RUN_BYTES = 1 << 20

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        z = z ^ (z >> U(30))
        z = z * U(0xBF58476D1CE4E5B9)
        z = z ^ (z >> U(27))
        z = z * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


_BYTE = _splitmix(256, 0xC0FFEE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Space and the five control characters that separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: For lexicons, every ASCII character but letters and digits separates.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False

_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, RUN_BYTES * 2)
        with np.errstate(over="ignore"):
            a = np.full(n, _P, U)
            b = np.full(n, _PINV, U)
            a[0] = b[0] = 1
            _pow, _inv = np.cumprod(a, dtype=U), np.cumprod(b, dtype=U)
    return _pow, _inv


class Words:
    """The words of a run of texts: byte spans, hashes and each text's range of words.

    ``sep`` says which bytes separate (bool), or gives classes of bytes: 0 separates, words are runs of
    one class, and those of class 2 single bytes.
    """

    def __init__(self, data: np.ndarray, edges: np.ndarray, lower: bool, sep: np.ndarray):
        o, d = edges, data
        self.raw = data
        if lower:
            d = _LOWER[d]
        self.bytes, self.edges = d, o
        n = len(d)
        kind = sep[d] if sep.dtype != bool else (~sep[d]).view(np.uint8)
        word = kind > 0
        first, last = word.copy(), word.copy()
        if n:
            edge = np.zeros(n + 1, bool)
            edge[o] = True
            turn = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | edge[1:n]
            first[1:] &= turn
            last[:-1] &= turn
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, o)
        pw, self._inv = _powers(n + 1)
        with np.errstate(over="ignore"):
            self._sum = np.zeros(n + 1, U)
            np.cumsum(_BYTE[d] * pw[:n], out=self._sum[1:], dtype=U)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self._sum[end] - self._sum[start]) * self._inv[start]
            return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def raw_runs(column: pa.Array):
    """Yield (first row, bytes, edges) for runs of about RUN_BYTES of text; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(column: pa.Array, lower: bool = False, sep: np.ndarray = SPACES):
    """Yield (first row, Words) for runs of texts."""
    for at, data, edges in raw_runs(column):
        yield at, Words(data, edges, lower, sep)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes (len(h) - k + 1 values; k is at most len(h))."""
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        s = h[:n].copy()
        for j in range(1, k):
            s *= U(_P)
            s += h[j : n + j]
        return mix(s + U(k))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of k consecutive words; a shorter text is one shingle."""
    every = rolling(w.hash, k) if len(w.hash) >= k else np.empty(0, U)
    out = []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(rolling(w.hash[a:b], b - a))
        else:
            out.append(np.empty(0, U))
    return out
