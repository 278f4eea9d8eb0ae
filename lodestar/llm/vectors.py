"""What the two vector operators share: which vectors take part, and small fixed samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import col


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec)`` of the vectors that take part.

    Null, empty and zero vectors, those with a null or non-finite component, and rows
    with a null id take no part.  Floats stay floats on the way (half the bytes, the same
    numbers); all arithmetic is in double precision.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = vectors.select(col(id_col).cast("bigint").alias("id"), col(vec_col).cast("array<float>" if single else "array<double>").alias("vec")).where("id is not null and vec is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))


def lengths(v: DataFrame, least: int = 2) -> list[int]:
    """Lengths that at least so many vectors have; products of vectors of different lengths are not defined."""
    return sorted(r.d for r in v.groupBy(F.size("vec").alias("d")).count().where(F.col("count") >= least).select("d").collect())


def sample(v: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` vectors, by hash of the id; the same for the same rows."""
    rows = v.orderBy(F.xxhash64("id"), "id", "vec").limit(n).select("vec").collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def stacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, dim))
