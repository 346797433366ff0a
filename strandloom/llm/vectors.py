"""Embeddings as whole numbers, so that products, distances and means are exact and no order of sums can move them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps to which a component is cut down, and the most that one may be (an x of 4,096): with it every sum of 2,048
#: products is exact in a double.
SCALE, MOST = 256, 1 << 20


def usable(embedding: Column) -> Column:
    """Whether a vector is there and no component of it is null, NaN or infinite."""
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(embedding: Column) -> Column:
    """floor(SCALE * x) of each component x; beyond MOST on either side it is MOST (less than that no result is moved)."""
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x.cast("double") * SCALE))
    return F.transform(embedding, lambda x: F.floor(held(x)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's lists as rows of doubles; components that a shorter one lacks count as 0."""
    if len(column) == 0:
        return np.zeros((0, width))
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(column), width).astype(np.float64)
    out = np.zeros((len(column), width))
    row, begin = np.repeat(np.arange(len(column)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.arange(len(flat)) - begin] = flat
    return out
