"""Walking over sorted Arrow batches group by group, and union-find on arrays, for the pair operators' workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that are gathered before the whole groups among them are handled.
BUFFER_ROWS = 20_000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with each row's group number, from batches sorted by ``keys`` (integers)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, size
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        number = np.cumsum(change)
        end = table.num_rows if last else int(np.searchsorted(number, number[-1]))
        if end:
            yield table.slice(0, end), number[:end]
        held = table.slice(end).to_batches() if end < table.num_rows else []
        size = table.num_rows - end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= BUFFER_ROWS:
                yield from cut(False)
    if held:
        yield from cut(True)


class Forest:
    """Union-find over 0..n-1 whose roots are the least members, kept flat so that they can be compared as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(flat := self.root[self.root], self.root):
                    self.root = flat
