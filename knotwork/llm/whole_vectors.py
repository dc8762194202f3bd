"""Vectors as whole numbers: which rows take part, and exact integer blocks of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond plus or minus this count as it.
MOST = float(1 << 62)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, dim: int | None = None) -> DataFrame:
    """``(vec_id, v array<double>)``, ``v`` being ``floor(scale * component)``, of the vectors without null or non-finite components.

    Null ids stay. ``dim`` keeps vectors of so many components only. Doubles hold the whole numbers, so huge components do not overflow.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    rows = rows if dim is None else rows.where(F.size("v") == dim)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    times = lambda x: x * F.lit(float(scale))
    # Adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal bytes.
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST))) + F.lit(0.0)
    return rows.select("vec_id", F.transform("v", lambda x: floor(times(x))).alias("v"))


def block_of(batch: pa.RecordBatch, dim: int, times: int = 1) -> np.ndarray:
    """The vectors of a batch, one a row: as int64, or as Python integers where ``times`` so much as they hold would not fit."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    most = float(np.abs(flat).max()) if flat.size else 0.0
    if most * times < MOST:
        return flat.astype(np.int64)
    return np.array([[int(x) for x in row] for row in flat], dtype=object).reshape(-1, dim)


def clipped(values) -> np.ndarray:
    """Whole numbers as longs; those beyond 64 bits become the largest or smallest long."""
    if getattr(values, "dtype", None) == np.int64:
        return values
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(int(x), low), high) for x in values], dtype=np.int64)
