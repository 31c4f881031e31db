from __future__ import annotations

import math

import pytest

from docmill.errors import Conflict, RequestError
from docmill.functions import values as V
from docmill.functions.analysis import analyzer, register, stem
from docmill.mapping import FieldMapping, extended, parse


def test_dates():
    assert V.to_date("2026-05-23T10:00:00Z") == 1779530400000
    assert V.to_date("2025-01-01T08:00:00+08:00") == V.to_date("2025-01-01") == 1735689600000
    assert V.to_date("1970-01-01T00:00:00.123456789Z", nanos=True) == 123456789
    assert V.to_date("2026") == 2026
    assert V.to_date(12.9) == 12
    for bad in ("not-a-date", "2026-13-01", "2026-01", None, True, ""):
        assert V.to_date(bad) is None
    assert V.to_date("2500-01-01", nanos=True) is None


def test_numbers_and_text():
    assert V.to_long("1.5") is None and V.to_long(" 12 ") == 12 and V.to_long(-1.9) == -1 and V.to_long(True) is None
    assert V.to_double("1d") == 1.0 and V.to_double("x") is None
    assert [V.text(x) for x in (True, 1, 1.0, 1e10, 0.001, [1, "a"], None)] == ["true", "1", "1.0", "1.0E10", "0.001", "[1, a]", "null"]
    assert V.wrapped(V.LONG_MAX + 1) == V.LONG_MIN


def test_addresses_points_ranges():
    assert V.to_ip("10.0.0.1")[-4:] == bytes([10, 0, 0, 1]) and V.to_ip("::1") == b"\0" * 15 + b"\1" and V.to_ip("example.com") is None
    assert V.to_point({"lat": 1, "lng": 2}) == V.to_point([1, 2]) == V.to_point("1, 2") == (1.0, 2.0) and V.to_point([100, 2]) is None
    assert V.to_range({"gt": 1, "lte": 5}, "long_range") == (2, 5)
    assert V.to_range([5, 1], "long_range") is None
    assert V.to_range({"lt": 1.0}, "double_range") == (-math.inf, math.nextafter(1.0, 0))
    assert V.to_range({"from": "10.0.0.0", "to": "10.0.0.9"}, "ip_range")[1][-1] == 9


def test_units():
    assert V.to_meters("2km") == 2000 and V.to_meters("1mi") == 1609.344 and V.to_meters(5) == 5 and V.to_meters("7") == 7
    assert V.to_millis("2m") == 120_000 and V.to_millis("250ms") == 250
    with pytest.raises(RequestError):
        V.to_millis("soon")


def test_mappings():
    m = parse({"mappings": {"properties": {"e": {"type": "dense_vector", "dims": 3}, "t": {"type": " TEXT ", "searchAnalyzer": "keyword"}, "k": {}}}})
    assert m["e"].dimension == 3 and m["t"].type == "text" and m["t"].search_analyzer == "keyword" and m["k"].type == "keyword" and m["k"].doc_values and not m["t"].doc_values
    with pytest.raises(RequestError):
        FieldMapping("dense_vector")
    with pytest.raises(RequestError):
        FieldMapping("nested")
    with pytest.raises(RequestError):
        FieldMapping("dense_vector", 3, "manhattan")
    assert extended(m, {"k": FieldMapping()}) == m
    with pytest.raises(Conflict):
        extended(m, {"k": FieldMapping("long")})


@pytest.mark.parametrize("word, root", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("agreed", "agre"), ("happy", "happi"), ("controlling", "control"), ("adjustment", "adjust"), ("sky", "sky")])
def test_stems(word, root):
    assert stem(word) == root


def test_analyzers(spark):
    from pyspark.sql import functions as F

    text = "The quick-brown Fox's e-mail, No. 42 ÉTÉ running"
    register("halves", None, lambda s: [s[: len(s) // 2], s[len(s) // 2 :]])
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    for name in ("standard", "keyword", "whitespace", "simple", "stop", "english", "halves"):
        a = analyzer(name)
        rows = [r[0] for r in df.select(a.column(F.col("t"))).collect()]
        assert rows[0] == a.tokens(text), name
        assert rows[2] is None, name
    assert analyzer("stop").tokens("The fox") == ["fox"] and "run" in analyzer("english").tokens(text)
    with pytest.raises(RequestError):
        analyzer("nobody")


def test_stems_of_a_batch_are_never_all_objects(monkeypatch):
    import pyarrow as pa

    from docmill.functions import analysis as A

    rows, sizes, stems_of = [["running", "cats"] * 50_000, None, [], ["a", "ponies"]], [], A._stems_of
    monkeypatch.setattr(A, "_stems_of", lambda words: sizes.append(len(words)) or stems_of(words))
    assert A._stems.func(pa.array([["cut off"], *rows]).slice(1)).to_pylist() == [None if r is None else [A.stem(w) for w in r] for r in rows]
    assert sum(sizes) == 100_002 and max(sizes) <= 65_536
