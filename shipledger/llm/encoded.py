"""Encodings of distinct pieces of text as flat arrays, remembered between
slices up to a bound."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 48  # bytes of a piece that is remembered


def gather(flat: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` (``sizes`` long, one after another) that
    ``number`` names, in its order."""
    first = np.cumsum(sizes) - sizes
    many = sizes[number]
    return flat[np.repeat(first[number] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


class Memory:
    """Ids of pieces, at most ``most`` of them. When it is full, what the last
    slice used stays and the rest is forgotten, so frequent pieces stay."""

    def __init__(self, most: int):
        self.most = most
        self.keys = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, distinct: pa.Array, make: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``distinct`` pieces, one after another, and how many each
        has. ``make`` gives the same for the new ones."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = distinct.take(pa.array(new))
        made, made_sizes = make(fresh)
        flat = np.concatenate([self.flat, made.astype(np.int32)])
        sizes = np.concatenate([self.sizes, made_sizes])
        at[new] = len(self.keys) + np.arange(len(new))
        self._remember(flat, sizes, fresh, at)
        return gather(flat, sizes, at), sizes[at]

    def _remember(self, flat: np.ndarray, sizes: np.ndarray, fresh: pa.Array, used: np.ndarray) -> None:
        keys = pa.concat_arrays([self.keys, fresh])
        if len(keys) <= self.most:
            keep = np.arange(len(keys))
        else:
            keep = np.unique(used)
        short = pc.binary_length(keys.take(pa.array(keep))).to_numpy(zero_copy_only=False) <= LONGEST
        keep = keep[short][: self.most]
        self.keys, self.flat, self.sizes = keys.take(pa.array(keep)), gather(flat, sizes, keep), sizes[keep]
