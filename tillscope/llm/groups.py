"""Work on sorted runs of equal keys inside tasks, on NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tillscope.llm.base import release


def whole_runs(batches, key: str = "key"):
    """Arrow tables in which every run of equal keys is whole; input sorted by ``key``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = keys[-1]
        start = int(np.searchsorted(keys, last, side="left"))
        piece = pa.Table.from_batches([batch])
        if held and held[-1].column(key)[-1].as_py() == last:
            held.append(piece)  # one run goes on through the whole batch
            continue
        held.append(piece.slice(0, start))
        table = pa.concat_tables(held)
        if table.num_rows:
            yield table
        held = [piece.slice(start)]
    if held:
        yield pa.concat_tables(held)
    held = []
    release()


def runs(keys: np.ndarray):
    """Start and end of every run of two or more equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    many = end - start > 1
    return start[many], end[many]


def smallest_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of 0..n-1 linked by (i, j) the smallest member of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
