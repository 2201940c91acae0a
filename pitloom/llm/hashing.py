"""Vectorised hashing of text batches: word shingles and gear hashes without a Python loop per character.

A batch of texts is laid end to end in one array, so each step is one numpy pass over the whole batch. All
hashes are 64 bits wide; two different inputs collide with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_MUL = U(0xBF58476D1CE4E5B9)
_MUL2 = U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _MUL
    x ^= x >> U(27)
    x *= _MUL2
    x ^= x >> U(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), U(base % 2**64), dtype=U)
    out[0] = U(1)
    return np.cumprod(out, dtype=U)


_powers: dict[int, np.ndarray] = {}


def _kept_powers(n: int, base: int) -> np.ndarray:
    """powers(n, base) out of a table that is kept for the next batches and grows with the largest one."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = _powers[base] = powers(max(n, 1 << 16) * 5 // 4, base)
    return table[:n]


class Rolling:
    """Polynomial hashes of any spans of one array, from prefix sums modulo 2**64 over mixed symbols."""

    base = int(_ODD)
    inverse = pow(int(_ODD), -1, 2**64)

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U)
        mixed = _BYTES[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(U) + U(1))
        np.cumsum(mixed * _kept_powers(n, self.base), out=self.sums[1:])
        self.down = _kept_powers(n + 1, self.inverse)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


class Rolling2(Rolling):
    """The same with another base, so that both together have 128 bits."""

    base = int(_MUL)
    inverse = pow(int(_MUL), -1, 2**64)


_BYTES = mix(np.arange(1, 257, dtype=U))
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True


def word_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` consecutive words (longest runs of a-z and 0-9 in the lower-cased text).

    Returns (hashes, text index of each hash, number of words of each text). Texts that are too short give no hash.
    """
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    data = np.frombuffer(b"\n".join(coded), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends_of_text = np.cumsum(lengths + 1)
    owner = np.searchsorted(ends_of_text, start, side="right")
    words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    if len(start) < width:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64), words
    h = Rolling(data).spans(start, end)
    n = len(h) - width + 1
    out = np.zeros(n, dtype=U)
    for k in range(width):
        out = mix(out + h[k : k + n] * _ODD + U(k + 1))
    keep = owner[:n] == owner[width - 1 :]
    return out[keep], owner[:n][keep], words


def distinct_sorted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each owner, ascending within the owner. Owners are numbers from 0 on."""
    order = np.argsort(hashes)
    small = owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner  # 16 bits are sorted by radix
    order = order[np.argsort(small[order], kind="stable")]
    h, o = hashes[order], owner[order]
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, o = h[keep], o[keep]
    return h, o
