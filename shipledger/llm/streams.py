"""Reading sorted Arrow batches group by group, with one group in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of ``keys`` (integers; the input is sorted by
    them) with the number of the group of each row. A group that goes on in
    the next batch is held back until it is whole."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        cols = [t[k].to_numpy() for k in keys]
        last = cols_equal(cols, t.num_rows - 1)
        cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut == 0 and held and not same_key(held[-1], t, keys):
            yield numbered(pa.concat_tables(held), keys)
            held = []
        if cut:
            yield numbered(pa.concat_tables([*held, t.slice(0, cut)]), keys)
            held = []
        held.append(t.slice(cut))
    if held:
        yield numbered(pa.concat_tables(held), keys)


def cols_equal(cols: list[np.ndarray], at: int) -> np.ndarray:
    return np.logical_and.reduce([c == c[at] for c in cols])


def same_key(a: pa.Table, b: pa.Table, keys: list[str]) -> bool:
    return all(a[k][a.num_rows - 1].as_py() == b[k][0].as_py() for k in keys)


def numbered(t: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return t.combine_chunks(), np.cumsum(new)
