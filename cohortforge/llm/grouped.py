"""Complete groups out of Arrow batches that arrive sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches, keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (the last may have fewer) that never cut a group.

    The memory held is ``rows`` and the largest group; callers bound the groups
    before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(len(table), dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        cut = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = len(table) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end of the last."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
