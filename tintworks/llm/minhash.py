"""One-permutation MinHash signatures with optimal densification, and their bands.

One hash for each shingle: its leading part chooses a bin, the rest competes to be
the bin's minimum.  An empty bin takes the value of the first non-empty bin in a
random order of its own, the same for every set, so that two sets agree in a bin
with the probability of their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .textkernel import mix64

EMPTY = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Bands:
    """`bands` keys of `rows` bins each."""

    bands: int
    rows: int

    @property
    def bins(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=4)
def _orders(bins: int) -> np.ndarray:
    """orders[t, i]: the bin that empty bin i asks in its turn t."""
    return np.ascontiguousarray(np.random.default_rng(20_170).permuted(np.tile(np.arange(bins, dtype=np.int64), (bins, 1)), axis=1).T)


def signatures(hashes: np.ndarray, owners: np.ndarray, n: int, bins: int) -> np.ndarray:
    """An n x bins matrix of bin minima; a set without shingles has only EMPTY.

    Repeated shingles change nothing, so they needn't be removed before.
    """
    out = np.full(n * bins, EMPTY, dtype=np.uint32)
    if len(hashes):
        cells = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) + np.asarray(owners, dtype=np.int64) * bins
        np.minimum.at(out, cells, np.minimum(hashes.astype(np.uint32), EMPTY - np.uint32(1)))
    own = out.reshape(n, bins).copy()
    out = out.reshape(n, bins)
    some = (own != EMPTY).any(axis=1)
    rows, holes = np.nonzero((own == EMPTY) & some[:, None])
    # every turn, all holes that are left ask the next bin of their order
    for asked in _orders(bins):
        if not len(rows):
            break
        given = own[rows, asked[holes]]
        found = given != EMPTY
        out[rows[found], holes[found]] = given[found]
        rows, holes = rows[~found], holes[~found]
    return out


def band_keys(signature: np.ndarray, shape: Bands) -> np.ndarray:
    """An n x bands matrix of 64-bit keys; the band's number is part of its key."""
    cells = signature.reshape(len(signature), shape.bands, shape.rows).astype(np.uint64)
    keys = np.broadcast_to(mix64(np.arange(1, shape.bands + 1, dtype=np.uint64)), cells.shape[:2])
    for k in range(shape.rows):
        keys = mix64((keys + np.uint64(0x9E3779B97F4A7C15)) ^ cells[:, :, k])
    return keys.view(np.int64)
