"""Groups of a sorted stream of Arrow batches, one at a time, so that only one group is in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal values in the first `n_keys` columns (integers without nulls).

    Groups may span batches; the input must be sorted, or at least grouped, by these columns.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if b.num_rows == 0:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[:, s])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)
