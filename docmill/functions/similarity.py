"""Vector similarities as column expressions, scored so that nearer is larger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def score(vector: Column, query: Sequence[float], similarity: str, byte: bool = False) -> Column:
    """The score of a vector column against a query vector: cosine (1 + cos) / 2, dot product (1 + dot) / 2 (for bytes 0.5 + dot / (dim 2^15)), euclidean 1 / (1 + d^2), maximum inner product above or below 1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
    if similarity == "euclidean":
        return 1 / (1 + _sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    if similarity == "maximum_inner_product":
        return F.when(dot < 0, F.try_divide(F.lit(1.0), 1 - dot)).otherwise(1 + dot)
    if similarity == "dot_product":
        return 0.5 + dot / (len(query) * 32768.0) if byte else (1 + dot) / 2
    length = sum(float(x) ** 2 for x in query) ** 0.5
    cosine = F.try_divide(dot, F.sqrt(_sum(F.transform(v, lambda a: a * a))) * F.lit(length))
    return (1 + F.coalesce(cosine, F.lit(0.0))) / 2
