"""Vector expressions over ARRAY columns, always in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit-length vector; the norm has a floor so that a zero vector stays zero."""
    v = as_double(vector)
    # one-element transform: computes the norm once per vector instead of once per element
    scaled = F.transform(
        F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(v, lambda x: x / n)
    )
    return F.element_at(scaled, 1)


def cosine_distance_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """1 - cosine similarity from a dot product and two norms; a zero vector has similarity 0."""
    scale = norm_a * norm_b
    return F.lit(1.0) - F.when(scale == 0, F.lit(0.0)).otherwise(product / scale)


def cosine_distance(a: Column, b: Column) -> Column:
    return cosine_distance_of(dot(a, b), norm(a), norm(b))


def round_to(value: Column, digits: int) -> Column:
    """Rounded value without negative zero, so that equal results compare and hash as equal."""
    return F.round(value, digits) + F.lit(0.0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
