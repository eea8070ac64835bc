"""Word and k-gram hashing over Arrow string buffers, a few megabytes at a time.

A word is a run of bytes of one class in the UTF-8 text. Word hashes are
polynomials modulo 2**64 over a random table of byte values, read off one
prefix sum; k-gram hashes are polynomials over the word hashes. All constants
are fixed, so every task and every run gets the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)

_bytes = np.arange(256)
#: Bytes of words between ASCII white space.
SPACED = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: Bytes of words of digits, letters a-z and everything beyond ASCII (after lower-casing).
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
_LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= SLICE_BYTES * 2:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of at most ``limit`` bytes (or one text), with the place of their first."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and the offsets of its texts in them."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return held, at - at[0]


class Words:
    """Words of consecutive texts: byte places, hashes, and each text's first word."""

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = False):
        data, at = raw(texts)
        if lower:
            data = _LOWER[data]
        self.data, self.at = data, at
        inside = kind[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        start[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        i = 0
        while i < len(self):
            low = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, low + SLICE_BYTES, "right")))
            n = int(self.end[j - 1] - low)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.data[low : low + n]] * _power(_BASE, n), out=sums[1:])
            a, b = self.start[i:j] - low, self.end[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * _power(_BASE_INVERSE, n)[a]
            i = j
        return mix(out)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave the text are garbage, see inside()."""
        n = max(0, len(self) - k + 1)
        acc = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            acc = acc * _GRAM + self.hash[j : j + n]
        return mix(acc)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one text."""
        n = max(0, len(self) - k + 1)
        return self.doc[:n] == self.doc[len(self) - n :]

    def whole(self, k: int) -> np.ndarray:
        """The k-word hash of each text that has exactly k words."""
        at = self.first[:-1][self.count == k]
        acc = np.full(len(at), np.uint64(k), np.uint64)
        for j in range(k):
            acc = acc * _GRAM + self.hash[at + j]
        return mix(acc)


def runs(n: int, spans_from: np.ndarray, spans_to: np.ndarray) -> np.ndarray:
    """Mask of n words that lie in any of the half-open spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans_from, 1)
    np.add.at(step, spans_to, -1)
    return np.cumsum(step[:-1]) > 0


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """List array of ``values`` cut into runs of ``counts``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
