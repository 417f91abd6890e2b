"""Bounded groups within sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key of a partition that is sorted by ``keys`` (integers), one batch a key.

    Only the key that is being read is held, so callers deal rows to keys of bounded size.
    """
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, columns))
        at = np.flatnonzero(change)
        for lo, hi in zip(np.r_[0, at], np.r_[at, batch.num_rows]):
            if lo in at or (lo == 0 and change[0]):
                if held:
                    yield joined()
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield joined()
