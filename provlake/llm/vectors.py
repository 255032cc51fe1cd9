"""Arrow columns of vectors as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest magnitude of a scaled component: 64 squared differences of such fit into 63 bits.
REACH = 1 << 27


def usable(vector: str, scale: int, dim: int | None = None) -> Column:
    """True for a vector whose components are all finite and scale to at most REACH in magnitude.

    ``dim`` asks for so many components.
    """
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double") * scale) < REACH), F.lit(False)))
    return F.coalesce(good & (F.size(v) == dim if dim is not None else F.lit(True)), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(column: pa.Array, scale: int, width: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, int64 matrix) of the usable vectors of an Arrow list column.

    Vectors of another length than ``width`` are left out where ``exact``, else filled with zeros
    or cut: components that one vector lacks add nothing to an inner product.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column).cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    held = np.maximum(length, 0)
    row = np.repeat(np.arange(len(length)), held)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * scale)
        bad = ~(np.abs(values * scale) < REACH)
    ok = (length >= 0) & (np.bincount(row[bad], minlength=len(length)) == 0)
    if exact:
        ok &= length == width
    at = np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    use = ok[row] & (at < width)
    out = np.zeros((len(length), width), np.int64)
    out[row[use], at[use]] = whole[use].astype(np.int64)
    rows = np.flatnonzero(ok)
    return rows, out[rows]
