"""A search request over an index: hits and aggregations as DataFrames, or a response as a service would give."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import values as V
from docmill.operators import aggregations, knn, relevance, sorting
from docmill.plans.dsl import Query, combined, compile_query
from docmill.plans.index import Index

HIT = ("_index", "_id", "_shard", "_score", "_source", "sort_values")


@dataclass(frozen=True)
class Found:
    """What a request finds. hits has one row for each hit, in order if collected; all fields of the index are beside it."""

    hits: DataFrame
    aggregations: dict[str, DataFrame]
    size: int
    shards: int = 1
    by: tuple[sorting.Key, ...] = ()

    def response(self) -> dict:
        """hits and aggregations collected: size rows at most, and buckets. Sort values are there as text in sort, of their fields' kinds in sort_values."""
        began = time.time()
        rows = self.hits.select(*HIT).collect() if self.size else []
        aggs = {k: [r.asDict() for r in d.collect()] for k, d in self.aggregations.items()}
        return {
            "took": round((time.time() - began) * 1000),
            "_shards": {"total": self.shards, "successful": self.shards, "failed": 0},
            "hits": [{"_index": r["_index"], "_id": r["_id"], "_score": r["_score"], "_source": json.loads(r["_source"]), "sort": list(r["sort_values"]), "sort_values": [k.shown(v) for k, v in zip(self.by, r["sort_values"])]} for r in rows],
            "aggregations": {k: v[0] if v and "key" not in v[0] else {"buckets": v} for k, v in aggs.items()},
        }


def _whole(body: Mapping, key: str, default: int) -> int:
    return max(0, int(body[key])) if V.number(body.get(key)) else default


def routed(index: Index, routing: object) -> Index:
    """The index cut to the one shard of a routing key, which prunes partitions where _shard is one."""
    if routing is None or index.shards == 1:
        return index
    key = str(routing) if str(routing).strip() else index.name
    number = zlib.crc32(key.encode()) % index.shards
    return replace(index, docs=index.docs.where(F.col("_shard") == number))


def matching(index: Index, query: object) -> tuple[DataFrame, Query]:
    """The documents that match a query body, unscored."""
    q = compile_query(query, index)
    return index.docs.where(q.matches()), q


def search(index: Index, body: Mapping) -> Found:
    """Run a search body: query, knn, sort, search_after, from, size, min_score, aggs, routing, stats.

    Scores count terms over the whole index; with stats "shard", over a document's own shard.
    """
    index = routed(index, body.get("routing"))
    vector_body = next((body[k] for k in ("vector", "knn") if isinstance(body.get(k), Mapping)), None)
    by = sorting.keys(body["sort"], index) if body.get("sort") else []
    start = _whole(body, "from", 0)
    after = body.get("search_after") or None
    least = body.get("min_score")
    if vector_body is not None:
        vq = knn.parse(vector_body, index)
        size = _whole(body, "size", vq.k)
        docs, _ = matching(index, combined(body.get("query"), (body.get("knn") or {}).get("filter") if isinstance(body.get("knn"), Mapping) else None))
        taken = max(size, vq.num_candidates)
        near = knn.scored(docs, vq, index)
        pool = near.orderBy(F.desc("_score"), "_id").limit(taken)
        least = vq.min_score if vq.min_score is not None else least
        hits = sorting.page(pool, by, start, size, after)
        aggregated = knn.candidates(near, taken, index)
    else:
        size = _whole(body, "size", 10)
        docs, q = matching(index, body.get("query"))
        scores = any(n == "_score" for n, _ in sorting.parse(body.get("sort") or [])) or not by or V.number(least)
        if scores and size and body.get("stats") == "shard" and index.shards > 1:
            score = relevance.by_shard(index, q)
        else:
            score = q.score(relevance.statistics(index, q) if scores and size else relevance.EMPTY)
        hits = sorting.page(docs.withColumn("_score", score.cast("double") if scores else F.lit(0.0)), by, start, size, after)
        aggregated = docs
    if V.number(least):
        hits = hits.where(F.col("_score") >= float(least))
    return Found(hits, aggregations.aggregate(aggregated, body.get("aggs"), index), size, 1 if body.get("routing") is not None else index.shards, tuple(by))


def knn_search(index: Index, body: Mapping) -> Found:
    """A search by vector only: body.knn or the body itself, under body.filter and knn.filter; k hits."""
    inner = body["knn"] if isinstance(body.get("knn"), Mapping) else body
    filters = combined(body.get("filter"), inner.get("filter") if inner is not body else None)
    return search(index, {"knn": {**inner, "filter": filters}, "size": _whole(inner, "k", 10), "routing": body.get("routing")})


def plan(index: Index, body: Mapping) -> dict:
    """What a search would read: shards and Spark's plan."""
    found = search(index, body)
    shards = sorted({r[0] for r in routed(index, body["routing"]).docs.select("_shard").distinct().collect()}) if body.get("routing") is not None else list(range(index.shards))
    return {"index": index.name, "shards": shards, "plan": found.hits._jdf.queryExecution().toString()}
