"""Registered queries, one for each operator over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.mapping import FieldMapping as M
from docmill.operators import search as S
from docmill.plans.dsl import combined
from docmill.plans.index import Index, of_columns, of_sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Index:
    """orders, with its date as epoch millis, and two derived columns that hold nulls."""
    t = _table(spark, sf_dir, "orders").withColumns({
        "o_orderdate": F.unix_millis(F.col("o_orderdate").cast("timestamp")),
        "price_or_null": F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")),
        "priority_or_null": F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_orderpriority")),
    })
    return of_columns(t, "o_orderkey", {
        "o_orderkey": M("long"), "o_custkey": M("long"), "o_orderstatus": M(), "o_orderpriority": M(), "o_totalprice": M("double"), "o_orderdate": M("date"), "price_or_null": M("double"), "priority_or_null": M(),
    }, "orders")


def lineitem(spark: SparkSession, sf_dir: str) -> Index:
    t = _table(spark, sf_dir, "lineitem").withColumns({
        "id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "l_shipdate": F.unix_millis(F.col("l_shipdate").cast("timestamp")),
        "modes": F.array("l_returnflag", "l_linestatus"),
    })
    return of_columns(t, "id", {
        "l_orderkey": M("long"), "l_linenumber": M("integer"), "l_quantity": M("double"), "l_extendedprice": M("double"), "l_discount": M("double"), "l_returnflag": M(), "l_linestatus": M(), "l_shipdate": M("date"), "modes": M(multi_valued=True),
    }, "lineitem")


def part(spark: SparkSession, sf_dir: str) -> Index:
    return of_columns(_table(spark, sf_dir, "part"), "p_partkey", {"p_name": M("text"), "p_brand": M(), "p_type": M(), "p_size": M("integer"), "p_retailprice": M("double")}, "part")


def documents(spark: SparkSession, sf_dir: str, analyzer: str | None = None) -> Index:
    return of_columns(_table(spark, sf_dir, "documents"), "doc_id", {"text": M("text", analyzer=analyzer), "lang": M(), "source": M(), "n_chars": M("long")}, "documents")


def embeddings(spark: SparkSession, sf_dir: str, similarity: str = "cosine") -> Index:
    return of_columns(_table(spark, sf_dir, "embeddings"), "vec_id", {"embedding": M("dense_vector", 64, similarity), "label": M("integer")}, "embeddings")


def events(spark: SparkSession, sf_dir: str) -> Index:
    """events with places, addresses, ranges and flags made from event_id by formulas that SQL repeats."""
    i = F.col("event_id")
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    address = lambda a, b: F.unhex(F.concat(F.lit("00000000000000000000FFFF0A00"), byte(a), byte(b)))
    t = _table(spark, sf_dir, "events").withColumns({
        "place": F.struct(((i * 37 % 1800 - 900) / 10).alias("lat"), ((i * 91 % 3600 - 1800) / 10).alias("lon")),
        "address": address(i % 7, i % 256),
        "span": F.struct((i % 100).alias("min"), (i % 100 + i % 13).alias("max")),
        "width": F.struct((i % 50 / 4).alias("min"), (i % 50 / 4 + i % 9).alias("max")),
        "net": F.struct(address(i % 7, F.lit(0)).alias("min"), address(i % 7, i % 256).alias("max")),
        "flag": i % 3 == 0,
        "raw": F.concat(F.lit("k"), (i % 4).cast("string")).cast("binary"),
        "ts": F.unix_millis(F.col("ts").cast("timestamp")),
        "nanos": F.unix_micros(F.col("ts").cast("timestamp")) * 1000,
    })
    return of_columns(t, "event_id", {
        "event_id": M("long"), "user_id": M("long"), "event_type": M(), "value": M("double"), "place": M("geo_point"), "address": M("ip"), "span": M("long_range"), "width": M("double_range"), "net": M("ip_range"), "flag": M("boolean"), "raw": M("binary"), "ts": M("date"), "nanos": M("date_nanos"),
    }, "events")


def ids(index: Index, query: dict, *more: str) -> DataFrame:
    """_id, as id, of all documents that match."""
    return S.matching(index, query)[0].select(F.col("_id").alias("id"), *more)


def hits(index: Index, body: dict, *more: str) -> DataFrame:
    return S.search(index, body).hits.select(F.col("_id").alias("id"), *more)


def agg(index: Index, query: dict, spec: dict) -> DataFrame:
    return S.search(index, {"query": query, "aggs": {"a": spec}, "size": 0}).aggregations["a"]


# -- the flagship: filter, sort, page; its aggregations are q_flagship_terms and q_flagship_avg

_FLAGSHIP = {
    "query": {"bool": {"filter": [{"term": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gte": 1000, "lt": 200000}}}]}},
    "sort": [{"o_totalprice": "desc"}, {"_id": "asc"}],
    "size": 10,
    "aggs": {"status": {"terms": {"field": "o_orderpriority", "size": 5}}, "mean": {"avg": {"field": "o_totalprice"}}},
}
_FLAGSHIP_WHERE = "o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_totalprice < 200000"


@registered(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE {_FLAGSHIP_WHERE} ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10")
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(orders(spark, sf_dir), _FLAGSHIP, "o_totalprice")


@registered(f"SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders WHERE {_FLAGSHIP_WHERE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q_flagship_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(orders(spark, sf_dir), _FLAGSHIP).aggregations["status"]


@registered(f"SELECT 'avg' AS type, 'o_totalprice' AS field, round(avg(o_totalprice), 2) AS value, count(*) AS count, round(sum(o_totalprice), 1) AS sum FROM orders WHERE {_FLAGSHIP_WHERE}")
def q_flagship_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(orders(spark, sf_dir), _FLAGSHIP).aggregations["mean"].select("type", "field", F.round("value", 2).alias("value"), "count", F.round("sum", 1).alias("sum"))


# -- predicates

_LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _predicate(name: str, make: Callable, query: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ids(make(spark, sf_dir), query)

    QUERIES[name], ORACLE_SQL[name] = run, sql


_predicate("q_match_all", orders, {}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders")
_predicate("q_ids", orders, {"ids": {"values": ["1", 7, "no", "32"]}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey IN (1, 7, 32)")
_predicate("q_term_keyword", orders, {"term": {"o_orderpriority": "1-URGENT"}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
_predicate("q_term_long", lineitem, {"term": {"l_linenumber": 3.7}}, f"SELECT {_LINE} AS id FROM lineitem WHERE l_linenumber = 3")
_predicate("q_term_double", lineitem, {"term": {"l_quantity": "17"}}, f"SELECT {_LINE} AS id FROM lineitem WHERE l_quantity = 17")
_predicate("q_term_boolean", events, {"term": {"flag": True}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 3 = 0")
_predicate("q_term_binary", events, {"term": {"raw": "azI="}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 4 = 2")
_predicate("q_term_ip", events, {"term": {"address": "10.0.3.10"}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 7 = 3 AND event_id % 256 = 10")
_predicate("q_term_multi", lineitem, {"term": {"modes": "A"}}, f"SELECT {_LINE} AS id FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'A'")
_predicate("q_term_text_token", documents, {"term": {"text": "license"}}, "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), 'license')")
_predicate("q_terms", part, {"terms": {"p_size": [1, 7, "15", 44]}}, "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size IN (1, 7, 15, 44)")
_predicate("q_terms_keyword", orders, {"terms": {"o_orderstatus": ["F", "P", "none"]}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus IN ('F', 'P', 'none')")
_predicate("q_prefix", part, {"prefix": {"p_type": {"value": "PROMO"}}}, "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE starts_with(p_type, 'PROMO')")
_predicate("q_prefix_text", documents, {"prefix": {"text": "licen"}}, "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: starts_with(x, 'licen'))) > 0")
_predicate("q_exists", orders, {"exists": {"field": "price_or_null"}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 7 <> 0")
_predicate("q_match_any", documents, {"match": {"text": "MIT License, released!"}}, "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ['mit', 'license', 'released'])")
_predicate("q_range_long", orders, {"range": {"o_custkey": {"gt": 100, "lte": "400"}}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey > 100 AND o_custkey <= 400")
_predicate("q_range_double_exclusive", lineitem, {"range": {"l_extendedprice": {"gt": 1000.5, "lt": 5000}}}, f"SELECT {_LINE} AS id FROM lineitem WHERE l_extendedprice > 1000.5 AND l_extendedprice < 5000")
_predicate("q_range_date", orders, {"range": {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-01-01T00:00:00Z"}}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE epoch_ms(o_orderdate) >= epoch_ms(TIMESTAMP '1995-01-01') AND epoch_ms(o_orderdate) < epoch_ms(TIMESTAMP '1996-01-01')")
_predicate("q_range_date_nanos", events, {"range": {"nanos": {"gte": "2024-01-10", "lte": "2024-01-12T12:00:00.5+02:00"}}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-12 10:00:00.5')")
_predicate("q_range_ip", events, {"range": {"address": {"gte": "10.0.2.0", "lt": "10.0.4.16"}}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE (event_id % 7) * 256 + event_id % 256 >= 512 AND (event_id % 7) * 256 + event_id % 256 < 1040")
for _relation, _test in {
    "intersects": "lo <= 30 AND hi >= 20", "within": "lo >= 20 AND hi <= 30", "contains": "lo <= 20 AND hi >= 30", "crosses": "lo <= 30 AND hi >= 20 AND NOT (lo >= 20 AND hi <= 30)",
}.items():
    _low, _high = ("24", "26") if _relation == "contains" else ("20", "30")
    _predicate(f"q_range_relation_{_relation}", events, {"range": {"span": {"gte": int(_low), "lte": int(_high), "relation": _relation}}}, f"SELECT CAST(event_id AS VARCHAR) AS id FROM (SELECT event_id, event_id % 100 AS lo, event_id % 100 + event_id % 13 AS hi FROM events) WHERE {_test.replace('20', _low).replace('30', _high)}")
_predicate("q_range_double_ranges", events, {"range": {"width": {"gt": 2.5, "lt": 4, "relation": "within"}}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 50 / 4 > 2.5 AND event_id % 50 / 4 + event_id % 9 < 4")
_predicate("q_range_ip_ranges", events, {"range": {"net": {"from": "10.0.3.100", "to": "10.0.3.120"}}}, "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 7 = 3 AND event_id % 256 >= 100")
_predicate(
    "q_bool_nested", lineitem,
    {"bool": {"filter": [{"range": {"l_quantity": {"gte": 10}}}], "must": {"terms": {"l_returnflag": ["A", "R"]}}, "should": [{"term": {"l_linestatus": "F"}}], "must_not": [{"bool": {"should": [{"range": {"l_discount": {"gt": 0.05}}}, {"term": {"l_linenumber": 1}}]}}]}},
    f"SELECT {_LINE} AS id FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R') AND NOT (l_discount > 0.05 OR l_linenumber = 1)",
)
_predicate("q_bool_should_only", orders, {"bool": {"should": [{"term": {"o_orderstatus": "P"}}, {"range": {"o_totalprice": {"gt": 400000}}}]}}, "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000")
_predicate(
    "q_bool_must_not_alone", orders, {"bool": {"should": [{"ids": {"values": ["1"]}}, {"bool": {"must_not": [{"term": {"o_orderstatus": "F"}}]}}]}},
    "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey = 1",
)
_HAVERSINE = "2 * 6371008.7714 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(31.2)) / 2), 2) + cos(radians(31.2)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(121.4)) / 2), 2))))"
_PLACES = "(SELECT event_id, (event_id * 37 % 1800 - 900) / 10 AS lat, (event_id * 91 % 3600 - 1800) / 10 AS lon FROM events)"
_predicate("q_geo_distance", events, {"geo_distance": {"place": {"lat": 31.2, "lon": 121.4}, "distance": "1500km"}}, f"SELECT CAST(event_id AS VARCHAR) AS id FROM {_PLACES} WHERE {_HAVERSINE} <= 1500000")
_predicate("q_geo_box", events, {"geo_bounding_box": {"place": {"top": 40, "bottom": -10.5, "left": 170, "right": -160}}}, f"SELECT CAST(event_id AS VARCHAR) AS id FROM {_PLACES} WHERE lat BETWEEN -10.5 AND 40 AND (lon >= 170 OR lon <= -160)")


@registered("SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings WHERE label = 3 OR label = 5")
def q_projection_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits carry the whole document as JSON; here a value is read back from it."""
    found = ids(embeddings(spark, sf_dir), {"terms": {"label": [3, 5]}}, "_source")
    return found.select("id", F.get_json_object("_source", "$.label").cast("int").alias("label"))


# -- relevance

_BM25 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS t FROM documents),
known AS (SELECT doc_id, t, len(t) AS dl FROM docs WHERE len(t) > 0),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM known),
words AS (SELECT unnest([{words}]) AS w),
df AS (SELECT w, count(*) AS df FROM words JOIN known ON list_contains(t, w) GROUP BY w),
parts AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) AS s
  FROM (SELECT doc_id, w, dl, CAST(len(list_filter(t, lambda x: x = w)) AS DOUBLE) AS tf FROM known, words WHERE list_contains(t, w)) JOIN df USING (w), stats)
SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(s), 6) AS score FROM parts GROUP BY doc_id ORDER BY sum(s) DESC, CAST(doc_id AS VARCHAR) LIMIT 25
"""


@registered(_BM25.format(words="'license', 'released', 'under'"))
def q_match_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), {"query": {"match": {"text": "Released under license"}}, "size": 25}, F.round("_score", 6).alias("score"))


@registered("""
WITH n AS (SELECT count(*) AS n, sum(CAST(lang = 'fr' AS INT)) AS fr, sum(CAST(source = 'src3' AS INT)) AS s3 FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, round(CASE WHEN lang = 'fr' THEN ln(1 + (n - fr + 0.5) / (fr + 0.5)) / 2.2 ELSE 0 END + CASE WHEN source = 'src3' THEN ln(1 + (n - s3 + 0.5) / (s3 + 0.5)) / 2.2 ELSE 0 END + 1, 6) AS score
FROM documents, n WHERE (lang = 'fr' OR source = 'src3') AND n_chars >= 500
ORDER BY 2 DESC, 1 LIMIT 40
""")
def q_bool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """should and must add up; filters do not count."""
    body = {"query": {"bool": {"must": [{"range": {"n_chars": {"gte": 500}}}], "filter": [{"bool": {"should": [{"term": {"lang": "fr"}}, {"term": {"source": "src3"}}]}}], "should": [{"term": {"lang": "fr"}}, {"term": {"source": "src3"}}]}}, "size": 40}
    return hits(documents(spark, sf_dir), body, F.round("_score", 6).alias("score"))


@registered(_BM25.format(words="'license', 'released', 'under'").replace("LIMIT 25", "LIMIT 1000000").replace("SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(s), 6) AS score FROM parts GROUP BY doc_id", "SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(s), 6) AS score FROM parts GROUP BY doc_id HAVING sum(s) >= 3"))
def q_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), {"query": {"match": {"text": "Released under license"}}, "size": 1000000, "min_score": 3}, F.round("_score", 6).alias("score"))


_BM25_SHARD = """
WITH known AS (SELECT *, len(t) AS dl FROM (SELECT doc_id, doc_id % 3 AS shard, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS t FROM documents) WHERE len(t) > 0),
stats AS (SELECT shard, count(*) AS n, avg(dl) AS mean FROM known GROUP BY shard),
words AS (SELECT unnest(['license', 'released']) AS w),
df AS (SELECT shard, w, count(*) AS df FROM words JOIN known ON list_contains(t, w) GROUP BY ALL),
parts AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)) AS s
  FROM (SELECT doc_id, shard, w, dl, CAST(len(list_filter(t, lambda x: x = w)) AS DOUBLE) AS tf FROM known, words WHERE list_contains(t, w)) JOIN df USING (shard, w) JOIN stats USING (shard))
SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(s), 6) AS score FROM parts GROUP BY doc_id ORDER BY sum(s) DESC, CAST(doc_id AS VARCHAR) LIMIT 25
"""


@registered(_BM25_SHARD)
def q_match_bm25_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the counts of each document's own shard."""
    index = documents(spark, sf_dir)
    index = replace(index, docs=index.docs.withColumn("_shard", (F.col("_id").cast("long") % 3).cast("int")), shards=3)
    return hits(index, {"query": {"match": {"text": "Released license"}}, "size": 25, "stats": "shard"}, F.round("_score", 6).alias("score"))


_predicate("q_list_as_filter", orders, combined([{"term": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gte": 150000}}}], {}), "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000")

# -- analyzers: a term is found if the analyzer makes it of the text, a query if it makes one of its terms

_DOC = "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE "
for _analyzer, _query, _sql in (
    ("whitespace", "License, released", "list_has_any(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), ['License,', 'released'])"),
    ("simple", "MIT-license2", "list_has_any(regexp_extract_all(lower(text), '\\p{L}+'), ['mit', 'license'])"),
    ("stop", "the license", "list_contains(regexp_extract_all(lower(text), '\\p{L}+'), 'license')"),
    ("english", "The licenses", "len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, 'licens(e|es|ed|ing)?'))) > 0"),
    ("standard", "Under_score LICENSE", "list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), ['under_score', 'license'])"),
):
    _predicate(f"q_analyzer_{_analyzer}", lambda spark, sf_dir, a=_analyzer: documents(spark, sf_dir, a), {"match": {"text": _query}}, _DOC + _sql)


@registered("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source = 'src3'")
def q_analyzer_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that is one token, as it is."""
    index = of_columns(_table(spark, sf_dir, "documents"), "doc_id", {"source": M("text", analyzer="keyword")}, "documents")
    return ids(index, {"match": {"source": "src3"}})


@registered("""
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 6 < 3 THEN event_id END AS n, CASE event_id % 3 WHEN 0 THEN event_id + 0.5 WHEN 1 THEN event_id + 0.25 END::DOUBLE AS x,
CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM events
""")
def q_lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose values are numbers or texts that read as numbers; of null and of others a field has no value."""
    i, text = F.col("event_id"), lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    n = F.when(i % 6 == 0, i.cast("string")).when(i % 6 == 1, text(i)).when(i % 6 == 2, F.concat(i.cast("string"), F.lit(".75"))).when(i % 6 == 3, "null").when(i % 6 == 4, '"none"').otherwise('{"a": 1}')
    x = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(".5"))).when(i % 3 == 1, text(F.concat(i.cast("string"), F.lit(".25")))).otherwise("null")
    flag = F.when(i % 4 == 0, "true").when(i % 4 == 1, '"false"').when(i % 4 == 2, '"true"').otherwise("null")
    source = F.concat(F.lit('{"n": '), n, F.lit(', "x": '), x, F.lit(', "flag": '), flag, F.lit("}"))
    rows = _table(spark, sf_dir, "events").select(i.cast("string").alias("_id"), F.lit("e").alias("_index"), F.lit(0).alias("_shard"), i.cast("long").alias("_seq"), source.alias("_source"))
    return of_sources(rows, {"n": M("long"), "x": M("double"), "flag": M("boolean")}).where("_error IS NULL").select(F.col("_id").alias("id"), "n", "x", "flag")


# -- vectors

_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_Q = f"CAST([{', '.join(map(str, _VECTOR))}] AS DOUBLE[])"
_E = "CAST(embedding AS DOUBLE[])"
_KNN = {
    "cosine": f"(1 + list_cosine_similarity({_E}, {_Q})) / 2",
    "dot_product": f"(1 + list_inner_product({_E}, {_Q})) / 2",
    "euclidean": f"1 / (1 + pow(list_distance({_E}, {_Q}), 2))",
    "maximum_inner_product": f"CASE WHEN list_inner_product({_E}, {_Q}) < 0 THEN 1 / (1 - list_inner_product({_E}, {_Q})) ELSE 1 + list_inner_product({_E}, {_Q}) END",
}


def _knn(similarity: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = {"knn": {"field": "embedding", "query_vector": _VECTOR, "k": 20}}
        return hits(embeddings(spark, sf_dir, similarity), body, F.round("_score", 6).alias("score"))

    name = f"q_knn_{similarity}"
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT CAST(vec_id AS VARCHAR) AS id, round({_KNN[similarity]}, 6) AS score FROM embeddings ORDER BY {_KNN[similarity]} DESC, 1 LIMIT 20"


for _s in _KNN:
    _knn(_s)


@registered(f"SELECT id, score FROM (SELECT CAST(vec_id AS VARCHAR) AS id, round({_KNN['cosine']}, 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY {_KNN['cosine']} DESC, 1 LIMIT 30) WHERE score >= 0.55")
def q_knn_filtered_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"knn": {"field": "embedding", "query_vector": _VECTOR, "k": 30, "filter": {"terms": {"label": [1, 2, 3]}}, "min_score": 0.55}}
    return hits(embeddings(spark, sf_dir), body, F.round("_score", 6).alias("score"))


@registered("""
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CAST(x AS DOUBLE) * 100) AS DOUBLE)) AS e FROM embeddings)
SELECT CAST(vec_id AS VARCHAR) AS id, round(0.5 + list_inner_product(e, %s) / (64 * 32768.0), 9) AS score FROM b ORDER BY list_inner_product(e, %s) DESC, 1 LIMIT 20
""".replace("%s", f"list_transform({_Q}, lambda x: x * 10)"))
def q_knn_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings").withColumn("small", F.transform("embedding", lambda x: (x.cast("double") * 100).cast("tinyint")))
    index = of_columns(t, "vec_id", {"small": M("byte_vector", 64, "dot_product")}, "bytes")
    body = {"knn": {"field": "small", "query_vector": [round(x * 10) for x in _VECTOR], "k": 20}}
    return hits(index, body, F.round("_score", 9).alias("score"))


@registered(f"SELECT CAST(label AS VARCHAR) AS key, count(*) AS doc_count FROM (SELECT label FROM embeddings ORDER BY {_KNN['cosine']} DESC, CAST(vec_id AS VARCHAR) LIMIT 50) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_knn_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregations of a vector search see its candidates."""
    body = {"knn": {"field": "embedding", "query_vector": _VECTOR, "k": 5, "num_candidates": 50}, "aggs": {"a": {"terms": {"field": "label"}}}}
    return S.search(embeddings(spark, sf_dir), body).aggregations["a"]


# -- order and pages


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_or_null FROM orders ORDER BY coalesce(price_or_null, -1e308) DESC, 1 LIMIT 5000")
def q_sort_missing_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(orders(spark, sf_dir), {"sort": [{"price_or_null": {"order": "desc"}}, "_id"], "size": 5000}, "price_or_null")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority_or_null FROM orders ORDER BY priority_or_null DESC NULLS FIRST, 1 DESC LIMIT 4000")
def q_sort_missing_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(orders(spark, sf_dir), {"sort": [{"priority_or_null": "desc"}, {"_id": "desc"}], "size": 4000}, "priority_or_null")


@registered(f"SELECT {_LINE} AS id, l_extendedprice FROM lineitem ORDER BY greatest(l_returnflag, l_linestatus) DESC, l_extendedprice, {_LINE} LIMIT 100")
def q_sort_multi_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(lineitem(spark, sf_dir), {"sort": [{"modes": "desc"}, "l_extendedprice", "_id"], "size": 100}, "l_extendedprice")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 40")
def q_from_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(orders(spark, sf_dir), {"sort": [{"o_totalprice": "desc"}, "o_orderkey"], "from": 40, "size": 25}, "o_totalprice")


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority FROM orders WHERE o_orderpriority > '2-HIGH' OR o_orderpriority = '2-HIGH' AND o_orderkey < 1000 ORDER BY o_orderpriority, o_orderkey DESC LIMIT 300")
def q_search_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(orders(spark, sf_dir), {"sort": ["o_orderpriority", {"o_orderkey": "desc"}], "search_after": ["2-HIGH", 1000], "size": 300}, "o_orderpriority")


@registered(_BM25.format(words="'license', 'released'").replace("ORDER BY sum(s) DESC, CAST(doc_id AS VARCHAR) LIMIT 25", "ORDER BY sum(s), CAST(doc_id AS VARCHAR) DESC LIMIT 10"))
def q_sort_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"query": {"match": {"text": "released license"}}, "sort": [{"_score": "asc"}, {"_id": "desc"}], "size": 10}
    return hits(documents(spark, sf_dir), body, F.round("_score", 6).alias("score"))


# -- aggregations


@registered("SELECT l_returnflag AS key, count(*) AS doc_count FROM lineitem WHERE l_quantity >= 25 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_agg_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(lineitem(spark, sf_dir), {"range": {"l_quantity": {"gte": 25}}}, {"terms": {"field": "l_returnflag"}})


@registered("SELECT v AS key, count(*) AS doc_count FROM (SELECT unnest([l_returnflag, l_linestatus]) AS v FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_agg_terms_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(lineitem(spark, sf_dir), {}, {"terms": {"field": "modes"}})


@registered("SELECT CASE WHEN o_orderkey % 5 = 0 THEN '_none' ELSE o_orderpriority END AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_agg_terms_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(orders(spark, sf_dir), {}, {"terms": {"field": "priority_or_null", "missing": "_none"}})


@registered("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS doc_count FROM events GROUP BY 1 HAVING count(*) >= 3 ORDER BY 1 LIMIT 50")
def q_agg_terms_key_min_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(events(spark, sf_dir), {}, {"terms": {"field": "user_id", "size": 50, "min_doc_count": 3, "order": {"_key": "asc"}}})


@registered("SELECT '10.0.' || event_id % 7 || '.' || event_id % 256 AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def q_agg_terms_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(events(spark, sf_dir), {}, {"terms": {"field": "address", "size": 20}})


@registered("SELECT CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS key, count(*) AS doc_count FROM events GROUP BY 1")
def q_agg_terms_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(events(spark, sf_dir), {}, {"terms": {"field": "flag"}})


@registered("SELECT json_extract_string(props, '$.k') AS key, count(*) AS doc_count FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def q_agg_terms_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field without mapping is read from the document."""
    t = _table(spark, sf_dir, "events")
    index = of_columns(t, "event_id", {"user_id": M("long")}, "events")
    source = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k")))
    index = Index(index.name, index.mappings, t.select(F.col("event_id").cast("string").alias("_id"), source.alias("_source"), "user_id"), 1, index.exact)
    return agg(index, {}, {"terms": {"field": "k", "size": 15}})


@registered("""
SELECT key, "from", "to", sum(n) AS doc_count FROM (
SELECT 'cheap' AS key, NULL::VARCHAR AS "from", '1000' AS "to", sum(CAST(p_retailprice < 1000 AS INT)) AS n FROM part
UNION ALL SELECT '950-1200.5', '950', '1200.5', sum(CAST(p_retailprice >= 950 AND p_retailprice < 1200.5 AS INT)) FROM part
UNION ALL SELECT '1500-*', '1500', NULL, sum(CAST(p_retailprice >= 1500 AS INT)) FROM part
UNION ALL SELECT 'none', '-5', '0', sum(CAST(p_retailprice >= -5 AND p_retailprice < 0 AS INT)) FROM part) GROUP BY ALL
""")
def q_agg_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and empty ranges."""
    spec = {"range": {"field": "p_retailprice", "ranges": [{"key": "cheap", "to": 1000}, {"from": 950, "to": 1200.5}, {"from": 1500}, {"key": "none", "from": -5, "to": 0}]}}
    return agg(part(spark, sf_dir), {}, spec)


@registered("""
SELECT 'early' AS key, NULL::VARCHAR AS "from", '1995-06-01' AS "to", count(*) AS doc_count FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'
UNION ALL SELECT 'late', '1995-06-01', NULL, count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'
""")
def q_agg_range_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(orders(spark, sf_dir), {}, {"range": {"field": "o_orderdate", "ranges": [{"key": "early", "to": "1995-06-01"}, {"key": "late", "from": "1995-06-01"}]}})


@registered("""
SELECT 'a' AS name, 'min' AS type, 'l_extendedprice' AS field, round(min(l_extendedprice), 2) AS value, count(*) AS count FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'b', 'max', 'l_extendedprice', round(max(l_extendedprice), 2), count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'c', 'sum', 'l_quantity', round(sum(l_quantity), 2), count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'd', 'value_count', 'l_shipdate', count(l_shipdate)::DOUBLE, count(*) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'e', 'value_count', 'l_returnflag', 0::DOUBLE, 0 FROM range(1)
""")
def q_agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without a number in it is not counted."""
    aggs = {"a": {"min": {"field": "l_extendedprice"}}, "b": {"max": {"field": "l_extendedprice"}}, "c": {"sum": {"field": "l_quantity"}}, "d": {"value_count": {"field": "l_shipdate"}}, "e": {"value_count": {"field": "l_returnflag"}}}
    found = S.search(lineitem(spark, sf_dir), {"query": {"term": {"l_returnflag": "R"}}, "aggs": aggs, "size": 0}).aggregations
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("name"), "type", "field", F.round("value", 2).alias("value"), "count")
        out = one if out is None else out.unionAll(one)
    return out


@registered("SELECT 'sum' AS type, 'flag' AS field, 0::DOUBLE AS value, 0 AS count")
def q_agg_sum_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg(events(spark, sf_dir), {}, {"sum": {"field": "flag"}})


# -- writes: the state after them


def _store(spark: SparkSession):
    from docmill.sources.store import Store

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return Store(spark, f"{(at or tempfile.mkdtemp(prefix='docmill-')).rstrip('/')}/store-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")


_ORDER = {"mappings": {"properties": {"status": {"type": "keyword"}, "price": {"type": "double"}}}}


def _loaded(spark: SparkSession, sf_dir: str):
    """A store whose index orders holds all of orders, under ids of their keys."""
    store = _store(spark)
    store.create_index("orders", _ORDER, 4)
    t = _table(spark, sf_dir, "orders")
    source = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    store.apply("orders", _ops(t.select(F.col("o_orderkey").cast("string").alias("id"), source.alias("source"), F.lit("index").alias("op"), F.lit(0).cast("long").alias("_seq"))))
    return store, t


def _ops(df: DataFrame) -> DataFrame:
    return df.withColumns({"routing": F.lit(None).cast("string"), "_error": F.lit(None).cast("string")})


def _state(store) -> DataFrame:
    return store.index("orders").docs.select(F.col("_id").alias("id"), "status", F.round("price", 2).alias("price"))


@registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'n' || o_orderkey, 'made', 1.0 FROM orders WHERE o_orderkey % 11 = 0
""")
def q_bulk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is written anew, then every fifth deleted; creates of what exists fail, others are made."""
    store, t = _loaded(spark, sf_dir)
    key, new = F.col("o_orderkey").cast("string"), F.to_json(F.struct(F.lit("new").alias("status"), F.col("o_totalprice").alias("price")))
    made = F.lit('{"status": "made", "price": 1.0}')
    n = lambda i: F.lit(i).cast("long").alias("_seq")
    upserts = t.where("o_orderkey % 3 = 0").select(key.alias("id"), new.alias("source"), F.lit("index").alias("op"), n(0))
    clashes = t.where("o_orderkey % 2 = 0").select(key.alias("id"), made.alias("source"), F.lit("create").alias("op"), n(1))
    creates = t.where("o_orderkey % 11 = 0").select(F.concat(F.lit("n"), key).alias("id"), made.alias("source"), F.lit("create").alias("op"), n(1))
    deletes = t.where("o_orderkey % 5 = 0").select(key.alias("id"), F.lit(None).cast("string").alias("source"), F.lit("delete").alias("op"), n(2))
    store.apply("orders", _ops(upserts.unionAll(clashes).unionAll(creates).unionAll(deletes)))
    return _state(store)


@registered("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'again' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'back', 2.0 FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0
""")
def q_bulk_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of action and document lines, blank lines between some: writes, creates that fail, deletes, creates of what was deleted, in the order of their lines."""
    store = _store(spark)
    store.create_index("orders", _ORDER, 4)
    key, line = F.col("o_orderkey"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    doc = lambda status, price: line('{"status": "', status, '", "price": ', price, "}\n")
    action = lambda kind: line(f'{{"{kind}": {{"_id": "', key, '"}}\n')
    some = lambda test, text: F.when(test, text).otherwise("")
    body = F.concat(
        action("index"), doc(F.col("o_orderstatus"), F.col("o_totalprice")), some(key % 5 == 0, F.lit("\n \r\n")),
        some(key % 4 == 0, F.concat(action("index"), doc(F.lit("again"), F.col("o_totalprice")))), action("create"), doc(F.lit("clash"), F.lit(1.0)),
        some(key % 7 == 0, action("delete")), some((key % 7 == 0) & (key % 3 == 0), F.concat(F.lit("\n"), action("create"), doc(F.lit("back"), F.lit(2.0)))),
    )
    requests = f"{store.root}/_requests"
    _table(spark, sf_dir, "orders").select(body.alias("value")).write.text(requests)
    store.bulk(requests, "orders")
    return _state(store)


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders WHERE NOT (o_totalprice >= 100000 AND o_orderstatus = 'O')")
def q_delete_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _loaded(spark, sf_dir)
    store.delete_by_query("orders", {"query": {"bool": {"filter": [{"range": {"price": {"gte": 100000}}}, {"term": {"status": "O"}}]}}})
    return _state(store)


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS price FROM orders")
def q_update_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _loaded(spark, sf_dir)
    store.update_by_query("orders", {"query": {"term": {"status": "P"}}, "doc": {"status": "pending"}})
    store.compact("orders")
    return _state(store)


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders")
def q_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point in time still sees what was deleted after it."""
    store, t = _loaded(spark, sf_dir)
    pit = store.open_pit("orders", "1h")
    store.delete_by_query("orders")
    store.collect_garbage("orders")
    docs = store.search("orders", {"size": t.count(), "sort": ["_id"]}, pit).hits
    return docs.select(F.col("_id").alias("id"), "status", F.round("price", 2).alias("price"))


@registered("SELECT CAST(user_id AS VARCHAR) AS id, CAST(event_id AS BIGINT) AS last FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def q_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to an index by a stream, one document a user: the last one stays."""
    from docmill.streaming.ingest import upserts

    store = _store(spark)
    store.create_index("users", {"mappings": {"properties": {"event": {"type": "long"}}}}, 2)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = stream.select(F.col("user_id").cast("string").alias("id"), F.to_json(F.struct(F.col("event_id").alias("event"))).alias("source"), F.col("event_id").alias("seq"))
    upserts(rows, store, "users", f"{store.root}/stream").awaitTermination()
    return store.index("users").docs.select(F.col("_id").alias("id"), F.col("event").alias("last"))
