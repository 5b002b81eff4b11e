"""Arrow-batched similarity measures that have no built-in expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_score(a: str, b: str) -> float:
    """Jaro similarity, boosted by up to four shared leading characters when above 0.7."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    taken = [False] * lb
    left = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = True
            left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, used in zip(b, taken) if used]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    score = (m / la + m / lb + (m - swaps) / m) / 3
    if score > 0.7:
        shared = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            shared += 1
        score += shared * 0.1 * (1 - score)
    return score


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two string columns, one Arrow batch at a time."""
    return pd.Series([jaro_winkler_score(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def as_matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """An Arrow list column as a matrix; rows that are null or of another size are NaN."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = sizes == dim
    out = np.full((len(vectors), dim), np.nan)
    if good.any():
        kept = vectors.filter(pa.array(good))
        out[good] = kept.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
    return out


def cosine_to(vector: list[float], column: Column) -> Column:
    """Cosine similarity of a vector column to one query vector; null when undefined.

    Whole Arrow batches are scored with one matrix-vector product.
    """
    query = np.asarray(vector, dtype="float64")
    query = query / (np.linalg.norm(query) or 1.0)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            matrix = as_matrix(vectors, len(query))
            with np.errstate(invalid="ignore", divide="ignore"):
                # Row by row in one order, so that equal vectors get equal scores.
                values = np.einsum("ij,j->i", matrix, query) / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            yield pa.array(values, mask=~np.isfinite(values))

    return score(column)
