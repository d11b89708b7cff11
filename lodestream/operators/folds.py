"""Rows read in order within a task, a block of a run at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; NULLs are alike."""
    a, b = column[1:], column[:-1]
    differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
    return differs.to_numpy(zero_copy_only=False)


def blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str] = ("run", "block")) -> Iterator[tuple[tuple, pa.Table]]:
    """The key and the rows of each block, of rows that come in order of the keys; one block is held at a time."""
    parts: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            ends |= _changed(batch.column(k))
        starts = [0, *(np.flatnonzero(ends) + 1).tolist(), batch.num_rows]
        own = list(zip(*(batch.column(k).take(pa.array(starts[:-1])).to_pylist() for k in keys)))
        for now, a, b in zip(own, starts, starts[1:]):
            if parts and now != key:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts)


def matrix(rows: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns' values as doubles, 0 where NULL, and whether each is there: rows by columns."""
    columns = [rows.column(n) for n in names]
    values = np.column_stack([c.fill_null(0.0).to_numpy() if c.null_count else c.to_numpy() for c in columns])
    there = np.column_stack([c.is_valid().to_numpy() if c.null_count else np.ones(len(c), bool) for c in columns])
    return values, there


def batched(tables: Iterator[pa.Table], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small tables, put together to batches of about so many rows."""
    held: list[pa.Table] = []
    n = 0
    for table in tables:
        held.append(table)
        n += table.num_rows
        if n >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.concat_tables(held).combine_chunks().to_batches()
