"""One-permutation minimum hashes of sets, densified, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def min_hashes(n: int, owner: np.ndarray, element: np.ndarray, bins: int) -> np.ndarray:
    """(n, bins) minima: each element falls in one bin of its set's row and each bin keeps its least hash.

    An empty bin borrows from a bin that is drawn by its number alone, so that two sets agree in a bin with the
    probability of their Jaccard similarity.  A set without elements has zeros.
    """
    out = np.full(n * bins, _NONE)
    h = mix64(element + _GOLD)
    cell = owner.astype(np.int64) * bins + ((h >> np.uint64(40)).astype(np.int64) % bins)
    np.minimum.at(out, cell, mix64(h))
    out = out.reshape(n, bins)
    has = np.zeros(n, bool)
    has[owner] = True
    out[~has] = 0
    row, bin_ = np.nonzero(out == _NONE)
    full = out != _NONE
    attempt = 1
    while len(row):
        source = (mix64(bin_.astype(np.uint64) * _GOLD + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = full[row, source]
        # the attempt enters the value, so that two bins that borrow alike still differ from a bin's own minimum
        out[row[found], bin_[found]] = mix64(out[row[found], source[found]] + np.uint64(attempt))
        row, bin_ = row[~found], bin_[~found]
        attempt += 1
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) keys as signed 64-bit integers: key b is made of the registers b, b + bands, b + 2 bands, ..."""
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)) * np.uint64(3)
    for r in range(rows):
        key = mix64(key * _GOLD + sig[:, r * bands : (r + 1) * bands])
    return key.view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """A two-dimensional array as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))
