"""What the two vector operators share: usable vectors, and the distinct ones among them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(x: Column) -> Column:
    """Whether a vector is not null, not zero, and holds no null or non-finite component."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, h, g) of the usable vectors, whatever their number of components.

    ``h`` and ``g`` are independent 64-bit hashes; equal vectors are told by the pair.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).filter(is_usable(F.col("embedding")))
    return v.withColumns({"dim": F.size("embedding"), "h": F.xxhash64(F.lit(7), "embedding"), "g": F.xxhash64(F.lit(11), "embedding")})


def scaled(column: pd.Series) -> np.ndarray:
    """Rows in double precision, times a power of two each, so that squares neither overflow nor vanish and no digit changes."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 1))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    return unit(scaled(column))
