"""Vector expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In double precision; 0 where a norm is 0. Norms that are known already can be handed in."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(_dot(a, b) / size)


def cosine_to(a: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, which becomes one literal array; over the shorter length, as the older engine does."""
    q = np.asarray(query, dtype=np.float64)
    literal = F.lit(q.tolist()) if len(q) else F.array().cast("array<double>")
    return cosine(F.slice(a, 1, len(q)) if len(q) else a, literal, norm(a), F.lit(float(np.sqrt((q * q).sum()))))


def matrix(vectors: list, width: int, kind=np.float64) -> np.ndarray:
    """Vectors as rows of one length, width at least: shorter ones are filled with zeros, which products and norms don't see.
    A null vector and one with a null in it become rows of NaN."""
    rows = [np.full(1, np.nan, dtype=kind) if v is None else np.asarray(v, dtype=np.float64).astype(kind) for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])), dtype=kind)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def inner_product_f32(query: list[float]):
    """Inner product of L2-normalised 32-bit vectors, a zero norm counting as 1 and the query's as 1e-9 at least; over the
    shorter length; null for a null vector or one with a null in it."""
    q = np.asarray(query, dtype=np.float32)
    q = q / max(float(np.linalg.norm(q)), 1e-9)

    @F.pandas_udf("float")
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = matrix(s.tolist(), len(q), np.float32)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            found = (m / np.where(size == 0, 1, size))[:, : len(q)] @ q
            yield pd.Series(found).where(~np.isnan(m).any(axis=1), None)

    return product


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))
