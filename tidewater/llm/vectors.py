"""Vector columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows whose vector has dim components (None: that of the most rows), all of
    them present and finite, and those vectors as doubles."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if dim is None:
        usual = np.bincount(size[size > 0]) if (size > 0).any() else np.array([0, 0])
        dim = int(usual.argmax())
    rows = np.nonzero(size == dim)[0]
    if dim <= 0 or not len(rows):
        return np.empty(0, np.int64), np.empty((0, max(dim, 0)))
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]
