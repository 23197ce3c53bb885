"""Arrow batches as numpy arrays, and runs of equal keys in sorted batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once inside a task. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(work: Work) -> Work:
    """The same work; its memory goes back to the system at the end of the task instead of staying with an idle worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Memory that is no longer used goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied_groups(work: Callable[..., pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``tidied`` for the function of two groups of one key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()

    return run


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last, bytes, offsets into the bytes) for consecutive rows; nulls count as empty."""
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys with the borders of the runs, from batches sorted by integer keys.

    Only the run that a batch breaks off is held over to the next one.
    """
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        first, last = tuple(v[0] for v in values), tuple(v[-1] for v in values)
        starts = np.flatnonzero(change)
        if held and held_key == first and not len(starts):
            held.append(table)
            continue
        if held and held_key == first:
            cut = int(starts[0])
            yield _joined([*held, table.slice(0, cut)]), np.array([0, cut + sum(t.num_rows for t in held)])
            table, starts = table.slice(cut), starts[1:] - cut
        elif held:
            yield _joined(held), np.array([0, sum(t.num_rows for t in held)])
        if len(starts):
            cut = int(starts[-1])
            yield _joined([table.slice(0, cut)]), np.concatenate([[0], starts])
            table = table.slice(cut)
        held, held_key = [table], last
    if held:
        yield _joined(held), np.array([0, sum(t.num_rows for t in held)])


def _joined(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    chunked = table.column(name)
    return chunked.chunk(0) if chunked.num_chunks == 1 else chunked.combine_chunks()
