"""Number arrays in tasks: integer vectors of list columns, exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(column).cast("array<double>"), fine), F.lit(False))


def limit(size: int, terms: int) -> int:
    """The largest power of two p so that `terms` * size * p * p fits in 63 bits."""
    return 1 << ((62 - (max(1, terms * size) - 1).bit_length()) // 2)


def integers(column: pa.ChunkedArray | pa.Array, scale: int, size: int, terms: int = 1) -> np.ndarray:
    """floor(scale * x) of list rows as an int64 matrix of `size` columns; missing components are 0.

    Beyond +-limit(size, terms), where an integer result would leave 64 bits, components stop there.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(limit(size, terms))
    flat = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (length == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(length), size), np.int64)
    out[np.arange(size) < length[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exact: in doubles while no sum can pass 2**53."""
    most = max((float(np.square(x.astype(np.float64)).sum(1).max()) for x in (a, b) if len(x)), default=0.0)
    if most < 2.0**52:  # no partial sum of a product exceeds the product of the norms
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
