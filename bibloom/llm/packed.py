"""Rows that hold many values as arrays: their columns in numpy, and arrays made of sorted columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """The numbers of a column, those of all its lists one after another."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # of none or several
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.flatten() if pa.types.is_list(column.type) else column
    return column.to_numpy(zero_copy_only=False)


def repeated(table: pa.Table, name: str, lists: str) -> np.ndarray:
    """The numbers of a column, each as often as a list has elements."""
    return np.repeat(numbers(table, name), pc.list_value_length(table.column(lists)).to_numpy())


def split(by: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The values of a sorted array, and where each begins, as the offsets of lists."""
    begins = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    return by[begins], pa.array(np.append(begins, len(by)).astype(np.int32))


def lists(offsets: pa.Array, values) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from those before them."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    return new
