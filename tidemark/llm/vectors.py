"""Vectors as whole numbers: which rows have them, and Arrow columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Components above it would leave 64-bit sums of squares; they raise an error.
LARGEST = 2**27


def whole(column: str, size: int | None = None) -> Column:
    """Whether a row has a vector (of that many components) in which every one is a finite number."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = v.isNotNull() & fine if size is None else v.isNotNull() & (F.size(v) == size) & fine
    return F.coalesce(ok, F.lit(False))


def quantised(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) whole numbers of an Arrow list column; shorter vectors end in zeros, longer ones are cut."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    numbers = np.floor(SCALE * flat)
    if len(numbers) and np.abs(numbers).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:g} have no exact 64-bit products")
    numbers = numbers.astype(np.int64)
    if (sizes == dim).all():
        return numbers.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = place < dim
    out[row[held], place[held]] = numbers[held]
    return out
