"""Shingle sets and one-permutation MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._words import SPACED, Words, mix

BINS = 128
#: A bin number for each try of an empty bin; enough tries that a run of misses has no weight.
_TRIES = 4096
_probe = np.random.Generator(np.random.PCG64(7)).integers(0, BINS, (_TRIES, BINS), dtype=np.int16)


def shingle_sets(texts: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the place of each text's first.

    Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer
    words is one shingle of all of them, a text without words has none.
    """
    words = Words(texts, SPACED, lower=True)
    ok = words.inside(gram)
    hashes, docs = [words.grams(gram)[ok]], [words.doc[: len(ok)][ok]]
    for k in range(1, gram):
        hashes.append(words.whole(k))
        docs.append(np.flatnonzero(words.count == k))
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(d[new], np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least hash of each bin for each non-empty set; empty bins are densified.

    The leading bits of a shingle's hash name its bin, so one hash function
    serves all bins. An empty bin takes the value of the first full bin in a
    random sequence of its own that is the same for every set: optimal
    densification, which keeps bins independent where few are full.
    """
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    cell = doc * BINS + (hashes >> np.uint64(57)).astype(np.int64)
    lead = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)  # sets are in order
    out = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    out[cell[lead]] = hashes[lead]
    full[cell[lead]] = True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    todo = np.argwhere(~full & full.any(1)[:, None])
    for i in range(_TRIES):
        if not len(todo):
            break
        other = _probe[i, todo[:, 1]]
        found = full[todo[:, 0], other]
        out[todo[found, 0], todo[found, 1]] = out[todo[found, 0], other[found]]
        todo = todo[~found]
    for row, column in todo:  # next to never
        out[row, column] = out[row, np.flatnonzero(full[row])[0]]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each ``rows`` bins."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    acc = np.zeros((n, k // rows), np.uint64)
    for j in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return acc


def sketches(signature: np.ndarray) -> np.ndarray:
    """One byte a bin, to estimate how many bins agree."""
    return (mix(signature) >> np.uint64(56)).astype(np.uint8)
