"""Whole groups of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups: each holds one or more runs of equal ``key``, none of them cut.

    A group is held until its last row has come; many small ones of a batch come together.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values."""
    if not len(values):
        return []
    cut = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(values)], strict=True))
