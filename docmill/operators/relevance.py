"""BM25 statistics of a query's terms: one aggregation over the index, whatever the number of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.plans.dsl import Query, Stats, Term
from docmill.plans.index import Index

EMPTY = Stats({}, {}, {})


def statistics(index: Index, query: Query) -> Stats:
    """Counts over all documents of the index of the terms that the query scores by; a single row comes to the driver."""
    return _counted(index, query, [])[None]


def by_shard(index: Index, query: Query) -> Column:
    """The score of each document by the counts of its own shard; a row for each shard comes to the driver."""
    score = F.lit(0.0)
    for shard, stats in _counted(index, query, ["_shard"]).items():
        score = F.when(F.col("_shard") == shard, query.score(stats)).otherwise(score) if shard is not None else query.score(stats)
    return score


def _counted(index: Index, query: Query, by: list[str]) -> dict[int | None, Stats]:
    terms: list[Term] = list(dict.fromkeys(query.terms))
    if not terms:
        return {None: EMPTY}
    fields = list(dict.fromkeys(f for f, _ in terms))
    place = {f: i for i, f in enumerate(fields)}
    cols, wanted = [], []

    def held(name: str, token: str):
        if name == "_field_names":
            return F.col(f"`{token}`").isNotNull() if token in index.exact else F.array_contains("_field_names", token)
        m = index.mappings[name]
        if m.type == "text":
            return F.array_contains(F.col(f"__t{place[name]}"), token)
        value = F.lit(token == "true") if m.type == "boolean" else F.lit(token)
        return F.array_contains(index.column(name), value) if m.many else index.column(name) == value

    for f in fields:
        text = f in index.mappings and index.mappings[f].type == "text"
        if text:
            cols.append(index.tokens(f).alias(f"__t{place[f]}"))
            n = F.size(F.col(f"__t{place[f]}"))
            wanted += [F.sum((n > 0).cast("long")).alias(f"n{place[f]}"), F.avg(F.when(n > 0, n)).alias(f"l{place[f]}")]
        else:
            some = F.lit(True) if f == "_field_names" else index.column(f).isNotNull()
            wanted += [F.sum(some.cast("long")).alias(f"n{place[f]}"), F.lit(1.0).alias(f"l{place[f]}")]
    wanted += [F.sum(F.coalesce(held(f, t), F.lit(False)).cast("long")).alias(f"d{i}") for i, (f, t) in enumerate(terms)]
    rows = index.docs.select("*", *cols).groupBy(*by).agg(*wanted).collect()
    stats = lambda row: Stats({f: row[f"n{i}"] or 0 for f, i in place.items()}, {f: row[f"l{i}"] or 1.0 for f, i in place.items()}, {t: row[f"d{i}"] or 0 for i, t in enumerate(terms)})
    return {r[by[0]] if by else None: stats(r) for r in rows}
