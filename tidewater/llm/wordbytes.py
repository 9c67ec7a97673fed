"""Words of Arrow string columns as bytes: exact strings instead of hashes, still without a loop over words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes: ASCII letters and every byte of a non-ASCII character.
ALPHABETIC = np.zeros(256, bool)
ALPHABETIC[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
#: Runs above this many bytes take the library's function one by one.
_LONG = 64


class Words:
    """Maximal runs of word bytes, A-Z lower-cased, with one blank after each; words of row i are bounds[i]:bounds[i + 1]."""

    def __init__(self, column: pa.Array, is_word: np.ndarray):
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
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.bounds = np.searchsorted(start, offsets)
        self.length = end - start
        self.start = np.concatenate(([0], np.cumsum(self.length + 1)))[:-1]
        flat = _LOWER[data[inside[1:-1]]]
        self.data = np.full(len(flat) + len(start), 32, np.uint8)
        self.data[np.arange(len(flat)) + np.repeat(np.arange(len(start)), self.length)] = flat
        self._flat = flat

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def strings(self) -> pa.Array:
        """All words as one string array."""
        ends = np.concatenate(([0], np.cumsum(self.length))).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.length), pa.py_buffer(ends), pa.py_buffer(self._flat))

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of bytes) of every run of ``width`` words inside one row, joined by blanks."""
        row_end = np.repeat(self.bounds[1:], np.diff(self.bounds))
        first = np.flatnonzero(np.arange(len(self.start)) + width <= row_end)
        last = first + width - 1
        return first, self.start[last] + self.length[last] - self.start[first]

    def crc32(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unsigned crc32 of the given runs."""
        start = self.start[first]
        order = np.argsort(-np.minimum(length, _LONG + 1).astype(np.int16), kind="stable")
        s, n = start[order], length[order]
        long = int(np.searchsorted(-n, -_LONG, "left"))  # these come first
        s, n = s[long:], n[long:]
        crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
        for k in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -k, "left"))
            head = crc[:m]
            crc[:m] = _CRC[(head ^ self.data[s[:m] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order[long:]] = crc ^ np.uint32(0xFFFFFFFF)
        for i in order[:long]:
            out[i] = zlib.crc32(self.data[start[i]:start[i] + length[i]])
        return out
