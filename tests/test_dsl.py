"""The compiler against a plain Python evaluator, on random queries over random documents."""

from __future__ import annotations

import random

import pytest

from docmill.errors import RequestError
from docmill.mapping import FieldMapping as M
from docmill.operators.search import matching, plan, search
from docmill.plans.index import of_columns, of_sources

MAPPINGS = {"k": M(), "n": M("long"), "d": M("double"), "b": M("boolean"), "t": M("text"), "m": M(multi_valued=True)}


def documents(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.25 else v
    return [(f"d{i}", maybe(r.choice("abc")), maybe(r.randint(-5, 5)), maybe(r.choice([0.5, 1.0, 2.5])), maybe(r.random() < 0.5), maybe(" ".join(r.choices(["red", "green", "blue"], k=3))), maybe(r.sample("xyz", r.randint(0, 3)))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return documents(3, 60)


@pytest.fixture(scope="module")
def index(spark, rows):
    return of_columns(spark.createDataFrame(rows, "id string, k string, n long, d double, b boolean, t string, m array<string>"), "id", MAPPINGS)


def naive(q: dict, row: dict) -> bool:
    if not q or "match_all" in q:
        return True
    kind, spec = next(iter(q.items()))
    if kind == "ids":
        return row["id"] in spec["values"]
    if kind == "exists":
        return row[spec["field"]] is not None
    if kind == "bool":
        needed = [naive(x, row) for x in spec.get("filter", []) + spec.get("must", [])]
        should = [naive(x, row) for x in spec.get("should", [])]
        if not any(spec.values()):
            return True
        return all(needed) and (bool(needed) or any(should)) and not any(naive(x, row) for x in spec.get("must_not", []))
    (field, v), x = next(iter(spec.items())), None
    x = row[field]
    if x is None:
        return False
    if kind == "term":
        return v in x if field == "m" else v in x.split() if field == "t" else x == v
    if kind == "terms":
        return any(naive({"term": {field: y}}, row) for y in v)
    if kind == "prefix":
        return any(y.startswith(v) for y in (x if field == "m" else x.split() if field == "t" else [x]))
    if kind == "match":
        return any(y in x.split() for y in v.lower().split())
    low, high = v.get("gte"), v.get("lt")
    return (low is None or x >= low) and (high is None or x < high)


def random_query(r: random.Random, depth: int = 2) -> dict:
    kinds = ["term", "terms", "prefix", "match", "range", "exists", "ids"] + ["bool"] * 4 * (depth > 0)
    kind = r.choice(kinds)
    if kind == "bool":
        return {"bool": {c: [random_query(r, depth - 1) for _ in range(r.randint(0, 2))] for c in ("filter", "must", "should", "must_not")}}
    if kind == "ids":
        return {"ids": {"values": [f"d{r.randint(0, 70)}" for _ in range(5)]}}
    if kind == "exists":
        return {"exists": {"field": r.choice(list(MAPPINGS))}}
    if kind == "range":
        return {"range": {r.choice("nd"): {k: v for k, v in {"gte": r.randint(-4, 2), "lt": r.randint(0, 5)}.items() if r.random() < 0.8}}}
    if kind == "match":
        return {"match": {"t": r.choice(["Red", "blue green", "none"])}}
    if kind == "prefix":
        return {"prefix": {r.choice("ktm"): r.choice(["a", "x", "gre", "q"])}}
    value = {"k": "a", "n": r.randint(-5, 5), "d": 2.5, "t": "red", "m": "y"}
    field = r.choice(list(value))
    return {"term": {field: value[field]}} if kind == "term" else {"terms": {field: [value[field], value[field]]}}


def test_random_queries(spark, index, rows):
    names = ["id", *MAPPINGS]
    docs = [dict(zip(names, r)) for r in rows]
    r = random.Random(11)
    queries = [random_query(r) for _ in range(80)]
    from pyspark.sql import functions as F

    from docmill.plans.dsl import compile_query

    compiled = [compile_query(q, index) for q in queries]
    tests = F.array(*[c.matches() for c in compiled])
    got = {x["_id"]: x["hit"] for x in index.docs.select("_id", tests.alias("hit")).collect()}
    for i, q in enumerate(queries):
        assert {k for k, v in got.items() if v[i]} == {d["id"] for d in docs if naive(q, d)}, q


@pytest.mark.parametrize("bad", [
    {"nothing": {}}, {"terms": {"k": "a"}}, {"prefix": {"n": "1"}}, {"prefix": {"k": None}}, {"exists": {"field": " "}}, {"term": {"n": "x"}}, {"range": {"k": {"gte": 1}}}, {"range": {"zz": {"gte": 1}}}, {"range": {"n": {"gt": "x"}}},
    {"geo_distance": {"k": [1, 2], "distance": 1}}, {"geo_bounding_box": {"field": "k", "top": 1}}, {"term": {}},
])
def test_errors_at_compile_time(index, bad):
    with pytest.raises(RequestError):
        matching(index, bad)


def found(index, query) -> set[str]:
    return {r[0] for r in matching(index, query)[0].select("_id").collect()}


def test_quirks_of_bounds(index, rows):
    assert found(index, {"term": {"zz": 1}}) == set()
    assert found(index, {"range": {"n": {"gte": 1, "gt": 3}}}) == {r[0] for r in rows if r[2] is not None and r[2] > 1}  # gte's value, exclusive
    assert found(index, {"range": {"n": {"gte": "junk"}}}) == {r[0] for r in rows if r[2] is not None}
    assert found(index, {"range": {"n": {"gte": 1.9}}}) == {r[0] for r in rows if r[2] is not None and r[2] >= 1}
    assert found(index, {"match": {"t": {"query": "red"}}}) == {r[0] for r in rows if r[5] and "red" in r[5].split()}  # the object's text is analysed
    assert found(index, {"bool": {"must_not": [{"term": {"k": "a"}}]}}) == set()
    assert found(index, {"bool": {}}) == found(index, {}) == {r[0] for r in rows}


def test_not_indexed_matches_nothing(spark):
    index = of_columns(spark.createDataFrame([("1", "a", 1)], "id string, k string, n long"), "id", {"k": M(indexed=False), "n": M("long", indexed=False)})
    assert found(index, {"term": {"k": "a"}}) == found(index, {"range": {"n": {"gte": 0}}}) == found(index, {"prefix": {"k": "a"}}) == set()
    assert search(index, {"aggs": {"s": {"sum": {"field": "n"}}}, "size": 0}).response()["aggregations"]["s"]["value"] == 1.0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS n", "cast(id AS string) AS k").write.parquet(str(tmp_path / "t"))
    index = of_columns(spark.read.parquet(str(tmp_path / "t")), "id", {"n": M("long"), "k": M()})
    text = plan(index, {"query": {"bool": {"filter": [{"term": {"n": 3}}, {"terms": {"n": [3, 4]}}]}}, "sort": ["n"]})["plan"]
    assert "EqualTo(n,3)" in text and "In(n, [3,4])" in text and "TakeOrderedAndProject" in text and "Exchange" not in text.split("== Physical Plan ==")[1]
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


SOURCES = [
    ('{"k": 1.0, "n": "12", "d": 1, "b": "TRUE", "m": ["x", 2]}', ("1.0", 12, 1.0, True, ["x", "2"])),
    ('{"k": 1e10, "n": 1.9, "d": "1d", "b": 0, "m": "x"}', ("1.0E10", 1, 1.0, False, ["x"])),
    ('{"k": ["a", "b"], "n": [1], "d": "x", "b": {}, "m": []}', ("[a, b]", None, None, False, [])),
    ('{"k": null, "n": "1.5"}', (None, None, None, None, None)),
    ('{"k": true, "n": true, "d": "NaN", "m": [null, 1.5]}', ("true", None, float("nan"), None, ["1.5"])),
]


def test_lenient_coercion(spark):
    df = spark.createDataFrame([(str(i), s) for i, (s, _) in enumerate(SOURCES)], "_id string, _source string")
    got = of_sources(df, {k: MAPPINGS[k] for k in "kndbm"}).orderBy("_id").collect()
    for r, (s, want) in zip(got, SOURCES):
        assert repr(tuple(r[k] for k in "kndbm")) == repr(want), s
        assert r["_error"] is None
    assert got[2]["_field_names"] == ["k", "n", "d", "b", "m"] and got[3]["_field_names"] == ["n"]


def test_strict_types(spark):
    m = {"when": M("date"), "ip": M("ip"), "v": M("dense_vector", 2), "raw": M("binary"), "nanos": M("date_nanos")}
    good = ['{"when": "2026-05-23T10:00:00Z", "ip": "::ffff:10.0.0.1", "v": [1, 2.5], "raw": "aGVsbG8=", "nanos": "1970-01-01T00:00:00.5Z"}', '{"when": 5, "ip": "2001:db8::1", "raw": [104, -1]}', '{}']
    bad = ['{"when": "soon"}', '{"ip": "example.com"}', '{"v": ["a", 1]}', '{"v": [1]}', '{"raw": "***"}', "[1]", "{", '{"ip": "1.2.3.4.5"}', '{"nanos": "2500-01-01"}', '{"when": "2026-13-01"}']
    df = spark.createDataFrame([(f"{i:02d}", s) for i, s in enumerate(good + bad)], "_id string, _source string")
    got = of_sources(df, m).orderBy("_id").collect()
    assert [r["_error"] is None for r in got] == [True] * len(good) + [False] * len(bad)
    assert got[0]["when"] == 1779530400000 and got[0]["nanos"] == 500_000_000 and bytes(got[0]["raw"]) == b"hello" and bytes(got[0]["ip"])[-4:] == bytes([10, 0, 0, 1]) and got[0]["v"] == [1.0, 2.5]
    assert bytes(got[1]["ip"]).hex() == "20010db8000000000000000000000001" and bytes(got[1]["raw"]) == bytes([104, 255])
