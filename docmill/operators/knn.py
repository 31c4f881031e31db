"""Exact nearest neighbours of a query vector among the documents that match a filter."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.errors import RequestError
from docmill.functions import similarity
from docmill.functions import values as V
from docmill.plans.index import Index


@dataclass(frozen=True)
class VectorQuery:
    field: str
    vector: tuple[float, ...]
    k: int = 10
    num_candidates: int = 10
    min_score: float | None = None


def parse(body: Mapping, index: Index) -> VectorQuery:
    """The vector query of a knn object, checked against the field's mapping."""
    whole = lambda key, default: int(body[key]) if V.number(body.get(key)) else default
    k = whole("k", 10)
    least = body["min_score"] if "min_score" in body else body.get("similarity")
    given = body.get("query_vector")
    vector = tuple(float(x) for x in given if V.number(x)) if isinstance(given, (list, tuple)) else ()
    name = body.get("field")
    m = index.mappings.get(name)
    if m is None:
        raise RequestError(f"knn: field {name} is not mapped")
    if not m.vector:
        raise RequestError(f"knn: field {name} holds no vectors")
    if not m.indexed:
        raise RequestError(f"knn: field {name} is not indexed")
    if len(vector) != m.dimension:
        raise RequestError(f"knn: field {name} has dimension {m.dimension}, the query {len(vector)}")
    if k < 1:
        raise RequestError("knn: k is 1 at least")
    if m.type == "byte_vector" and any(x != int(x) or not -128 <= x <= 127 for x in vector):
        raise RequestError(f"knn: the query of {name} takes whole numbers from -128 to 127")
    return VectorQuery(name, vector, k, max(k, whole("num_candidates", max(10, k))), float(least) if V.number(least) else None)


def scored(docs: DataFrame, q: VectorQuery, index: Index) -> DataFrame:
    """docs that have a vector, with its _score."""
    m = index.mappings[q.field]
    found = docs.where(index.column(q.field).isNotNull())
    return found.withColumn("_score", similarity.score(index.column(q.field), q.vector, m.similarity, m.type == "byte_vector"))


def candidates(docs: DataFrame, n: int, index: Index) -> DataFrame:
    """The n nearest of each shard, which a request's aggregations see. Of one shard it is an ordered limit."""
    if index.shards == 1:
        return docs.orderBy(F.desc("_score"), "_id").limit(n)
    best = Window.partitionBy("_shard").orderBy(F.desc("_score"), F.asc("_id"))
    return docs.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= n).drop("__rank")
