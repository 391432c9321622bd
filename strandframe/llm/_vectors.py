"""Vectors of Arrow columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of doubles) for each length over 0 that vectors of the column have; null vectors are left out.

    Null entries become NaN.
    """
    ends = column.offsets.to_numpy().astype(np.int64)
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(ends))
    flat = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy()
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        yield at, flat[ends[at][:, None] + np.arange(n)]


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The tables of rows alike in the columns by (numbers without nulls), of batches sorted by them; one run is held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        starts = [0, *cuts.tolist(), table.num_rows]
        if held and any(held[0].column(c)[0].as_py() != table.column(c)[0].as_py() for c in by):
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(starts, starts[1:], strict=False):
            held.append(table.slice(a, b - a))
            if b < table.num_rows:
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)
