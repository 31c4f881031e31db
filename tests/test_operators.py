from __future__ import annotations

import math

import pytest

from docmill.errors import RequestError
from docmill.mapping import FieldMapping as M
from docmill.operators import sorting
from docmill.operators.search import knn_search, matching, search
from docmill.plans.index import Index, of_columns, of_sources


def hits(index, body):
    return [(h["_id"], h["_score"]) for h in search(index, body).response()["hits"]]


def names(index, body):
    return [h for h, _ in hits(index, body)]


@pytest.fixture(scope="module")
def books(spark):
    rows = [("doc-1", "search", 80), ("doc-2", "storage", 160), ("doc-3", None, 260), ("doc-4", "search", None)]
    source = {"doc-1": '{"category":"search","pages":80}', "doc-2": '{"category":"storage","pages":160}', "doc-3": '{"pages":260}', "doc-4": '{"category":"search","pages":[80,90]}'}
    df = spark.createDataFrame([(i, 0, source[i]) for i, _, _ in rows], "_id string, _shard int, _source string")
    m = {"category": M(), "pages": M("long")}
    return Index("books", m, of_sources(df, m))


def aggs(index, spec, **more):
    return search(index, {"aggs": {"a": spec}, "size": 0, **more}).response()["aggregations"]["a"]


def test_terms(books):
    b = aggs(books, {"terms": {"field": "category", "missing": "__missing__", "order": {"_key": "asc"}}})["buckets"]
    assert [(x["key"], x["doc_count"]) for x in b] == [("__missing__", 1), ("search", 2), ("storage", 1)]
    assert [x["key"] for x in aggs(books, {"terms": {"field": "category", "min_doc_count": 2}})["buckets"]] == ["search"]
    assert [x["key"] for x in aggs(books, {"terms": {"field": "category", "size": 1, "order": {"_count": "asc"}}})["buckets"]] == ["storage"]
    assert {x["key"]: x["doc_count"] for x in aggs(books, {"terms": {"field": "pages"}})["buckets"]} == {"80": 2, "90": 1, "160": 1, "260": 1}


def test_ranges_count_a_document_once(books):
    ranges = [{"key": "short", "to": 100}, {"key": "medium", "from": 100, "to": 200}, {"from": 200}]
    b = aggs(books, {"range": {"field": "pages", "ranges": ranges}})["buckets"]
    assert [(x["key"], x["doc_count"]) for x in b] == [("short", 2), ("medium", 1), ("200-*", 1)]
    same = aggs(books, {"range": {"field": "pages", "ranges": [{"key": "x", "to": 100}, {"key": "x", "from": 200}]}})["buckets"]
    assert [(x["key"], x["doc_count"]) for x in same] == [("x", 3)]
    for bad in ([], [{"from": "bad"}], [{"to": "bad"}]):
        with pytest.raises(RequestError):
            aggs(books, {"range": {"field": "pages", "ranges": bad}})


def test_metrics(books):
    q = {"query": {"range": {"pages": {"lt": 200}}}}
    assert aggs(books, {"avg": {"field": "pages"}}, **q) == {"type": "avg", "field": "pages", "value": 120.0, "count": 2, "sum": 240.0}
    assert aggs(books, {"value_count": {"field": "pages"}})["value"] == 5.0
    assert aggs(books, {"min": {"field": "none"}})["value"] is None and aggs(books, {"sum": {"field": "none"}})["value"] == 0.0
    assert aggs(books, {"value_count": {"field": "category"}})["count"] == 0
    assert search(books, {"aggs": {"a": {"median": {"field": "pages"}}}}).aggregations == {}
    assert search(books, {"aggs": [{"name": "b", "max": {"field": "pages"}}], "size": 0}).response()["aggregations"]["b"]["value"] == 260.0


def test_empty_index(spark):
    index = of_columns(spark.createDataFrame([], "id string, k string, n long"), "id", {"k": M(), "n": M("long")})
    r = search(index, {"query": {"term": {"k": "a"}}, "aggs": {"t": {"terms": {"field": "k"}}, "s": {"sum": {"field": "n"}}, "r": {"range": {"field": "n", "ranges": [{"to": 1}]}}}}).response()
    assert r["hits"] == [] and r["aggregations"]["t"]["buckets"] == [] and r["aggregations"]["s"]["value"] == 0.0 and r["aggregations"]["r"]["buckets"][0]["doc_count"] == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("doc-1", "a", [1.0, 0.0], [10, 0, 0, 0]), ("doc-2", "b", [0.0, 1.0], [0, 10, 0, 0]), ("doc-3", "b", None, None), ("doc-4", "b", [0.0, 0.0], [1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "id string, k string, v array<float>, w array<tinyint>")
    return lambda similarity: of_columns(df, "id", {"k": M(), "v": M("dense_vector", 2, similarity), "w": M("byte_vector", 4, similarity)})


def test_similarities(vectors):
    knn = lambda s, f="v", q=(1, 0), **more: hits(vectors(s), {"knn": {"field": f, "query_vector": list(q), "k": 4, **more}})
    assert knn("cosine") == [("doc-1", 1.0), ("doc-2", 0.5), ("doc-4", 0.5)]
    assert knn("dot_product") == [("doc-1", 1.0), ("doc-2", 0.5), ("doc-4", 0.5)]
    assert knn("euclidean")[0] == ("doc-1", 1.0) and math.isclose(dict(knn("euclidean"))["doc-2"], 1 / 3)
    assert dict(knn("maximum_inner_product", q=(-2, 0)))["doc-1"] == 1 / 3 and dict(knn("maximum_inner_product", q=(3, 0)))["doc-1"] == 4.0
    assert dict(knn("dot_product", "w", (10, 0, 0, 0)))["doc-1"] == 0.5 + 100 / (4 * 32768)
    assert knn("cosine", min_score=0.99) == [("doc-1", 1.0)] == knn("cosine", similarity=0.99)
    assert [i for i, _ in knn("cosine", filter={"term": {"k": "b"}})] == ["doc-2", "doc-4"]


def test_knn_requests(vectors):
    index = vectors("cosine")
    assert names(index, {"knn": {"field": "v", "query_vector": [1, 0], "k": 1, "num_candidates": 3}, "size": 2}) == ["doc-1", "doc-2"]  # size beats k
    assert names(index, {"knn": {"field": "v", "query_vector": [1, 0], "k": 3}, "sort": [{"_id": "desc"}]})[0] == "doc-4"
    found = knn_search(index, {"knn": {"field": "v", "query_vector": [0, 1], "k": 1, "filter": {"term": {"k": "b"}}}, "filter": [{"exists": {"field": "v"}}]})
    assert [h["_id"] for h in found.response()["hits"]] == ["doc-2"]
    for bad in ({"field": "k", "query_vector": [1]}, {"field": "zz", "query_vector": [1]}, {"field": "v", "query_vector": [1]}, {"field": "w", "query_vector": [1.5, 0, 0, 0]}, {"field": "v", "query_vector": [1, 0], "k": 0}):
        with pytest.raises(RequestError):
            search(index, {"knn": bad})


@pytest.fixture(scope="module")
def sortable(spark):
    rows = [("a", 3, None, ["x", "z"], None), ("b", None, "k", ["y"], 1.5), ("c", 1, "m", None, -2.0), ("d", 3, "k", [], 1.5)]
    df = spark.createDataFrame(rows, "id string, n long, s string, m array<string>, f double")
    return of_columns(df, "id", {"n": M("long"), "s": M(), "m": M(multi_valued=True), "f": M("double")})


def test_sort_orders(sortable):
    by = lambda *s: names(sortable, {"sort": list(s)})
    assert by("n") == ["c", "a", "d", "b"] and by({"n": "desc"}) == ["a", "d", "c", "b"]  # missing numbers last both ways
    assert by("s") == ["b", "d", "c", "a"] and by({"s": {"order": "desc"}}) == ["a", "c", "b", "d"]  # missing strings first if descending
    assert by("m") == ["a", "b", "c", "d"] and by({"m": "desc"}) == ["c", "d", "a", "b"]
    assert by({"_id": "desc"}) == ["d", "c", "b", "a"]
    assert search(sortable, {"sort": ["n"]}).response()["hits"][3]["sort"] == ["9223372036854775807"]
    for bad in ("zz", {"_shard": "asc"}):
        with pytest.raises(RequestError):
            by(bad)


def test_pages_and_cursors(sortable):
    assert names(sortable, {"sort": ["_id"], "from": 1, "size": 2}) == ["b", "c"] and names(sortable, {"size": 0}) == [] and names(sortable, {"from": -3, "size": 1, "sort": ["_id"]}) == ["a"]
    for sort in (["n", "_id"], [{"n": "desc"}, {"_id": "desc"}], ["s", "_id"], [{"s": "desc"}, "_id"], ["f", {"_id": "desc"}]):
        whole, seen, after = names(sortable, {"sort": sort}), [], None
        while True:
            page = search(sortable, {"sort": sort, "size": 1, **({"search_after": after} if after else {})}).response()["hits"]
            if not page:
                break
            seen, after = seen + [page[0]["_id"]], page[0]["sort"]
        assert seen == whole, sort
    for bad in ({"search_after": [1]}, {"sort": ["n", "_id"], "search_after": [1]}, {"sort": ["n"], "search_after": ["x"]}):
        with pytest.raises(RequestError):
            search(sortable, bad)
    assert sorting.parse(["a", {"b": "desc", "c": "asc"}, {"_score": {}}, 5]) == [("a", False), ("b", True), ("_score", True)]


def test_bm25(spark):
    docs = [("1", "red red blue"), ("2", "blue"), ("3", "red green blue white"), ("4", None)]
    index = of_columns(spark.createDataFrame(docs, "id string, t string"), "id", {"t": M("text")})
    n, mean = 3, 8 / 3

    def score(tf, df, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean))

    got = dict(hits(index, {"query": {"match": {"t": "RED white"}}}))
    assert got.keys() == {"1", "3"} and math.isclose(got["1"], score(2, 2, 3)) and math.isclose(got["3"], score(1, 2, 4) + score(1, 1, 4))
    assert dict(hits(index, {"query": {"bool": {"filter": [{"match": {"t": "red"}}]}}})) == {"1": 0.0, "3": 0.0}
    assert names(index, {"query": {"match": {"t": "red"}}, "min_score": 0.2}) == ["1"]
    assert names(index, {"query": {"match": {"t": " !"}}}) == []


def test_geo(spark):
    df = spark.createDataFrame([("sh", (31.2304, 121.4737)), ("bj", (39.9042, 116.4074)), ("fj", (-17.7, 178.0)), ("none", None)], "id string, p struct<lat: double, lon: double>")
    index = of_columns(df, "id", {"p": M("geo_point")})
    ids = lambda q: {r[0] for r in matching(index, q)[0].select("_id").collect()}
    assert ids({"geo_distance": {"p": "31.2304,121.4737", "distance": "2km"}}) == {"sh"}
    assert ids({"geo_distance": {"field": "p", "lat": 31, "lon": 121, "distance_meters": 2_000_000}}) == {"sh", "bj"}
    assert ids({"geo_bounding_box": {"p": {"top_left": [0, 170], "bottom_right": [-30, -170]}}}) == {"fj"}
    assert ids({"bool": {"filter": [{"match_all": {}}], "must_not": [{"geo_bounding_box": {"p": {"top": 90, "bottom": -90, "left": -180, "right": 180}}}]}}) == {"none"}
