"""Arrow list columns of vectors as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, double matrix) for each vector length of the column.

    Left out: null and empty vectors and those with null or non-finite components.
    """
    n = len(column)
    if not n:
        return []
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    out = []
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if good.any():
            out.append((rows[good], x[good]))
    return out
