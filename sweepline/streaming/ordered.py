"""Stateful processors that need a key's rows in order, whatever the size of a micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bytes of a key's rows that are held before they wait in the state store.
HELD = 32 << 20


class Ordered(StatefulProcessor):
    """Sorts a key's rows of a micro-batch, of which it holds `held` bytes and a block at a time.

    Rows come in Arrow batches, in no order. Up to `held` bytes of them are sorted as they are. Where
    there are more, they are put down in the state store by blocks of `block_rows` order numbers, a
    value for each block of what was held, and taken up again block by block. What waits is gone
    when the micro-batch ends.
    """

    order: str
    columns: tuple[str, ...]  # of a row, the order number first
    block_rows: int

    def __init__(self, held: int = HELD):
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long, part long", "rows binary")

    def rows_of(self, batch: pd.DataFrame) -> list[tuple]:
        """The rows as tuples of Python values and arrays of numbers; nulls as None."""
        return list(zip(*([None if x is None or (not isinstance(x, np.ndarray) and x != x) else x for x in batch[c].tolist()] for c in self.columns), strict=True))

    @staticmethod
    def _bytes(row: tuple) -> int:
        return 400 + sum(x.nbytes for x in row if isinstance(x, np.ndarray))

    def in_order(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows: list[tuple] = []
        size = 0
        parts: dict[int, int] = {}  # of each block that waits the number of its values
        for batch in batches:
            for row in self.rows_of(batch):
                rows.append(row)
                size += self._bytes(row)
            if size > self.held:
                self._put(rows, parts)
                rows, size = [], 0
        if not parts:
            yield from sorted(rows, key=lambda r: r[0])
            return
        self._put(rows, parts)
        del rows
        for block in sorted(parts):
            whole: list[tuple] = []
            for part in range(parts[block]):
                whole += pickle.loads(self.waiting.getValue((block, part))[0])
                self.waiting.removeKey((block, part))
            yield from sorted(whole, key=lambda r: r[0])

    def _put(self, rows: list[tuple], parts: dict[int, int]) -> None:
        blocks: dict[int, list[tuple]] = {}
        for r in rows:
            blocks.setdefault(int(r[0] // self.block_rows), []).append(r)
        for block, own in blocks.items():
            part = parts.get(block, 0)
            self.waiting.updateValue((block, part), (pickle.dumps(own),))
            parts[block] = part + 1

    def close(self) -> None:
        pass


def frames(rows: Iterator[tuple], columns: list[str], most: int = 2000) -> Iterator[pd.DataFrame]:
    """The rows as frames of bounded size, nulls as None."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)
