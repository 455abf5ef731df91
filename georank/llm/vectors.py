"""Arrow list columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def clean_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, float64 matrix) for each length of the column's vectors.

    Null vectors and those with a null or non-finite component are left out.
    """
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)), -1).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        matrix = flat[starts[rows][:, None] + np.arange(dim)[None, :]].reshape(len(rows), dim)
        ok = np.isfinite(matrix).all(axis=1)
        yield dim, rows[ok], matrix[ok]
