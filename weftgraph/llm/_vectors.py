"""Vectors of integers from a column of float arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """Is the array there, with no entry null, NaN or infinite?"""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int, limit: int, kind: str) -> DataFrame:
    """vec_id and x, the entries as floor(scale * entry) + shift, of the rows whose vectors are whole.

    Entries beyond the limit on either side become the limit: squares and sums stay within 64 bits.
    """
    v = F.col(f"`{vec_col}`")
    return (
        df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
        .where(whole(F.col("v")))
        .select("vec_id", F.transform("v", lambda x: (F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(-float(limit)))) + shift).cast(kind)).alias("x"))
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as an int64 matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.empty((0, 0), np.int64)
