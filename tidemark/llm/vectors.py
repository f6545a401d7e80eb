"""What the operators on embeddings share: which rows hold a whole vector, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def whole_vectors(df: DataFrame, vector: str, width: int | None = None) -> tuple[DataFrame, int]:
    """Rows whose vector is not null, holds neither nulls nor non-finite numbers and has `width` entries (default: the most frequent
    length, of several the largest), and that width. An empty table has width 0."""
    entries = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(entries, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.where(entries.isNotNull() & ~bad)
    if width is None:
        found = kept.groupBy(F.size(entries).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
        width = found["width"] if found else 0
    return kept.where(F.size(entries) == width), width


def matrix(column, width: int, dtype) -> np.ndarray:
    """An Arrow list column of vectors of one width as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(len(column), width)
