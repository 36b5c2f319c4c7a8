"""Small sequential kernels over many small groups without a call per group from the JVM.

Rows of one group meet by one exchange and a sort within partitions; Arrow batches then stream through the kernel, which gets
whole groups as slices of columns. A group cut by a batch border is carried over, so memory holds one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True at each row whose value differs from the row before; nulls are equal to each other."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def map_groups(df: DataFrame, by: list[str], order: list, kernel: Callable[[dict[str, np.ndarray], list[tuple[int, int]]], dict], schema: str) -> DataFrame:
    """``kernel(columns, bounds)`` gets the columns of some whole groups and each group's (start, end), rows in ``order``, and returns the
    output columns. A null key is a group like any other."""
    placed = df.repartition(*by).sortWithinPartitions(*by, *order)
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = {c: np.asarray(t.column(c).to_numpy()) for c in t.column_names}
            ends = [*starts[1:].tolist(), t.num_rows]
            made = kernel(columns, list(zip(starts.tolist(), ends)))
            yield from pa.table({n: made[n] for n in names}).to_batches()

        carry: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if carry is not None:
                t = pa.concat_tables([carry, t]).combine_chunks()
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in by:
                new[1:] |= _changes(t.column(c))
            starts = np.nonzero(new)[0]
            cut = int(starts[-1])
            if cut:
                yield from out(t.slice(0, cut).combine_chunks(), starts[:-1])
            carry = t.slice(cut)
        if carry is not None and carry.num_rows:
            yield from out(carry.combine_chunks(), np.array([0]))

    return placed.mapInArrow(run, schema)
