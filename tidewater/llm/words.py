"""Words and word hashes of Arrow string columns, computed with numpy over whole batches instead of word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes of text whose words are hashed at a time.
SLICE = 1 << 18
_BASE = _U(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE_INV = _U(_inverse(int(_BASE)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.default_rng(20240601).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: Word bytes: everything but blank and \\x09-\\x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word (splitmix64)."""
    x = x + _BASE
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = made[0], made[1]
    return _powers


class Batch:
    """The words of a string column: ``hash`` per word (A-Z lower-cased), ``bounds``: words of row i are bounds[i]:bounds[i+1]."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, prefixes: tuple[int, ...] = ()):
        column = column.cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
        low = int(offsets[0])
        offsets = offsets - low
        data = np.frombuffer(data, np.uint8)[low:low + int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = is_word[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.bounds = np.searchsorted(self.start, offsets)
        words = len(self.start)
        self.hash = np.empty(words, np.uint64)
        self.prefix = {k: np.empty(words, np.uint64) for k in prefixes}
        i = 0
        while i < words:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SLICE, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            power, inverse = _power_tables(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_CODE[_LOWER[data[a:b]]] * power[:b - a], out=sums[1:])
            s, e = self.start[i:j] - a, self.end[i:j] - a
            at, back = sums[s], inverse[s]
            self.hash[i:j] = mix((sums[e] - at) * back)
            for k, out in self.prefix.items():
                out[i:j] = mix((sums[np.minimum(e, s + k)] - at) * back + _U(k))
            i = j

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes, one row at least."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def shingles(batch: Batch, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of ``width`` consecutive words; a shorter text is one shingle as a whole."""
    h = batch.hash
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | _U(1)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k, f in enumerate(factors):
        rolled += h[k:k + len(rolled)] * f
    rolled = mix(rolled)
    out = []
    for a, b in zip(batch.bounds[:-1], batch.bounds[1:]):
        if b - a >= width:
            s = np.sort(rolled[a:b - width + 1])
            out.append(s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((h[a:b] * factors[:b - a]).sum(keepdims=True, dtype=np.uint64) ^ _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
