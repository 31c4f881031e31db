"""The query language, compiled: each query gives a boolean column and a score column.

Errors of a query are raised when it is compiled. A predicate that is null counts as false, as in a filter, so that
leaves stay plain comparisons, which Spark pushes to the scan; only what is negated is made false first. Scores are
built from literals: the statistics that BM25 needs of the terms in a query are gathered in one pass beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.errors import RequestError
from docmill.functions import values as V
from docmill.functions.analysis import analyzer
from docmill.mapping import DATES, DOUBLE_RANGES, DOUBLES, LONG_RANGES, LONGS
from docmill.plans.index import Index

K1, B = 1.2, 0.75
#: A term whose frequency a score needs: field, token; a field that is not analysed counts as one token.
Term = tuple[str, str]


@dataclass(frozen=True)
class Stats:
    """Of the documents with a field: how many, their mean length; and how many hold a term."""

    docs: Mapping[str, int]
    mean: Mapping[str, float]
    holding: Mapping[Term, int]

    def idf(self, term: Term) -> float:
        n, df = self.docs.get(term[0], 0), self.holding.get(term, 0)
        return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs) if cs else F.lit(False)


class Query:
    """A compiled query. terms are those that scoring needs statistics of."""

    terms: tuple[Term, ...] = ()

    def matches(self) -> Column:
        raise NotImplementedError

    def score(self, stats: Stats) -> Column:
        """The score of a document that matches."""
        return F.lit(1.0)


@dataclass(frozen=True)
class Constant(Query):
    """Documents by a predicate, each scored 1."""

    predicate: Column

    def matches(self) -> Column:
        return self.predicate


class Everything(Query):
    def matches(self) -> Column:
        return F.lit(True)


class Nothing(Query):
    def matches(self) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class Holds(Query):
    """Documents with a term, scored by BM25. Fields that are not analysed have frequency and length 1. plus is added, as for exists."""

    term: Term
    held: Column
    tokens: Column | None
    plus: float = 0.0

    @property
    def terms(self) -> tuple[Term, ...]:
        return (self.term,)

    def matches(self) -> Column:
        return self.held

    def score(self, stats: Stats) -> Column:
        idf = stats.idf(self.term)
        if self.tokens is None:
            return F.lit(idf / (1 + K1) + self.plus)
        tf = F.size(F.filter(self.tokens, lambda t: t == self.term[1])).cast("double")
        mean = stats.mean.get(self.term[0]) or 1.0
        return F.lit(idf) * tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.size(self.tokens) / F.lit(mean)))


@dataclass(frozen=True)
class Bool(Query):
    filters: tuple[Query, ...]
    must: tuple[Query, ...]
    should: tuple[Query, ...]
    must_not: tuple[Query, ...]

    @property
    def terms(self) -> tuple[Term, ...]:
        return tuple(t for q in (*self.must, *self.should) for t in q.terms)

    def matches(self) -> Column:
        needed = [q.matches() for q in (*self.filters, *self.must)]
        if not needed:  # then one of should is needed; must_not alone matches nothing
            needed = [_any([q.matches() for q in self.should])]
        return _all(needed + [~F.coalesce(q.matches(), F.lit(False)) for q in self.must_not])

    def score(self, stats: Stats) -> Column:
        parts = [q.score(stats) for q in self.must] + [F.when(q.matches(), q.score(stats)).otherwise(0.0) for q in self.should]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def compile_query(body: object, index: Index) -> Query:
    """The query of a body: of the known kinds the first present, in a fixed order."""
    q = body if isinstance(body, Mapping) else {}
    if not q or "match_all" in q:
        return Everything()
    for kind in ("ids", "term", "terms", "prefix", "exists", "match", "bool", "range", "geo_distance", "geo_bounding_box"):
        if kind in q:
            spec = q[kind]
            if not isinstance(spec, Mapping):
                raise RequestError(f"{kind} takes an object")
            return _KINDS[kind](spec, index)
    raise RequestError(f"no query is called {', '.join(map(str, q))}")


def _entry(kind: str, spec: Mapping) -> tuple[str, object]:
    if not spec:
        raise RequestError(f"{kind} needs a field")
    return next(iter(spec.items()))


def _ids(spec: Mapping, index: Index) -> Query:
    ids = spec.get("values")
    wanted = [V.text(x) for x in ids] if isinstance(ids, (list, tuple)) else []
    return Constant(F.col("_id").isin(wanted)) if wanted else Nothing()


def _exact(name: str, value: object, index: Index) -> Query:
    if name == "_id":
        return Constant(F.col("_id") == V.text(value))
    m = index.mappings.get(name)
    if m is None:
        return Nothing()
    c = index.column(name)
    same = (lambda x: F.array_contains(c, x)) if m.many else (lambda x: c == x)
    if m.type in ("keyword", "text", "boolean"):
        if not m.indexed:
            return Nothing()
        term = V.text(value)
        if m.type == "text":
            return Holds((name, term), F.array_contains(index.tokens(name), term), index.tokens(name))
        if m.type == "boolean":
            return Holds((name, term), same(F.lit(term == "true")), None) if term in ("true", "false") else Nothing()
        return Holds((name, term), same(F.lit(term)), None)
    if m.type in LONGS:
        exact = V.to_long(value)
    elif m.type in DATES:
        exact = V.to_date(value, m.type == "date_nanos")
    elif m.type in DOUBLES:
        exact = V.to_double(value)
    elif m.type == "ip":
        exact = V.to_ip(value)
    elif m.type == "binary":
        exact = V.to_binary(value)
    else:
        raise RequestError(f"term does not work on field {name}")
    if exact is None:
        raise RequestError(f"field {name}: {value!r} is no {m.type}")
    return Constant(same(F.lit(exact))) if m.indexed else Nothing()


def _term(spec: Mapping, index: Index) -> Query:
    return _exact(*_entry("term", spec), index)


def _terms(spec: Mapping, index: Index) -> Query:
    name, value = _entry("terms", spec)
    if not isinstance(value, (list, tuple)):
        raise RequestError(f"terms needs a list for field {name}")
    each = tuple(_exact(name, v, index) for v in value)
    m = index.mappings.get(name)
    if each and m is not None and not m.many and all(isinstance(q, Constant) for q in each) and m.type in (*LONGS, *DATES, *DOUBLES):
        read = V.to_long if m.type in LONGS else V.to_double if m.type in DOUBLES else lambda v: V.to_date(v, m.type == "date_nanos")
        return Constant(index.column(name).isin([read(v) for v in value]))  # pushed down as one In
    return Bool((), (), each, ()) if each else Nothing()


def _prefix(spec: Mapping, index: Index) -> Query:
    name, value = _entry("prefix", spec)
    value = value.get("value") if isinstance(value, Mapping) else value
    if value is None:
        raise RequestError(f"prefix needs a value for field {name}")
    start = V.text(value)
    if name == "_id":
        return Constant(F.col("_id").startswith(start))
    m = index.mappings.get(name)
    if m is None:
        return Nothing()
    if m.type not in ("keyword", "text", "boolean"):
        raise RequestError(f"prefix does not work on field {name}")
    if not m.indexed:
        return Nothing()
    if m.type == "text":
        return Constant(F.exists(index.tokens(name), lambda t: t.startswith(start)))
    c = index.column(name)
    return Constant(F.exists(c, lambda t: t.cast("string").startswith(start)) if m.many else c.cast("string").startswith(start))


def _exists(spec: Mapping, index: Index) -> Query:
    name = spec.get("field")
    if not isinstance(name, str) or not name.strip():
        raise RequestError("exists needs a field")
    if name == "_id":
        return Everything()
    if name not in index.mappings:
        return Nothing()
    held = index.column(name).isNotNull() if name in index.exact else F.array_contains("_field_names", name)
    return Holds(("_field_names", name), held, None, plus=1.0)


def _match(spec: Mapping, index: Index) -> Query:
    name, value = _entry("match", spec)
    m = index.mappings.get(name)
    if m is None or m.type != "text":
        return _exact(name, value, index)
    found = [t for t in analyzer(m.search_analyzer or m.analyzer).tokens(V.text(value)) if t.strip()]
    if not found or not m.indexed:
        return Nothing()
    each = tuple(Holds((name, t), F.array_contains(index.tokens(name), t), index.tokens(name)) for t in found)
    return _AnyToken((), (), each, (), index.tokens(name), tuple(found))


@dataclass(frozen=True)
class _AnyToken(Bool):
    """Any of several tokens of a field: one overlap test rather than a test for each."""

    tokens: Column
    wanted: tuple[str, ...]

    def matches(self) -> Column:
        return F.arrays_overlap(self.tokens, F.array(*map(F.lit, self.wanted)))


def _bool(spec: Mapping, index: Index) -> Query:
    def each(key: str) -> tuple[Query, ...]:
        v = spec.get(key)
        items = v if isinstance(v, (list, tuple)) else [v]
        return tuple(compile_query(x, index) for x in items if isinstance(x, Mapping))

    made = Bool(each("filter"), each("must"), each("should"), each("must_not"))
    return made if any((made.filters, made.must, made.should, made.must_not)) else Everything()


def _range(spec: Mapping, index: Index) -> Query:
    name, b = _entry("range", spec)
    m = index.mappings.get(name)
    if m is None:
        raise RequestError(f"range: field {name} is not mapped")
    if not isinstance(b, Mapping):
        raise RequestError(f"range needs bounds for field {name}")
    if m.type in (*LONG_RANGES, *DOUBLE_RANGES, "ip_range"):
        return _range_of_ranges(name, b, index)
    low, high = b["gte"] if "gte" in b else b.get("gt"), b["lte"] if "lte" in b else b.get("lt")
    above, below = "gt" in b, "lt" in b

    def bound(value: object, exclusive: bool, read):
        found = read(value) if value is not None else None
        if exclusive and found is None:
            raise RequestError(f"field {name}: no valid range bound {value!r}")
        return found

    if m.type in LONGS or m.type in DATES:
        read = V.to_long if m.type in LONGS else lambda v: V.to_date(v, m.type == "date_nanos")
        lo, hi = bound(low, above, read), bound(high, below, read)
        lo = V.wrapped(lo + above) if lo is not None else None
        hi = V.wrapped(hi - below) if hi is not None else None
    elif m.type in DOUBLES:
        lo, hi = bound(low, above, V.to_double), bound(high, below, V.to_double)
        lo = math.nextafter(lo, math.inf) if above else lo
        hi = math.nextafter(hi, -math.inf) if below else hi
    elif m.type == "ip":
        lo, hi = bound(low, above, V.to_ip), bound(high, below, V.to_ip)
        lo = V.next_ip(lo, 1) if above else lo
        hi = V.next_ip(hi, -1) if below else hi
    else:
        raise RequestError(f"range does not work on field {name}")
    if not m.indexed:
        return Nothing()
    within = lambda x: _all([x.isNotNull(), *([x >= F.lit(lo)] if lo is not None else []), *([x <= F.lit(hi)] if hi is not None else [])])
    c = index.column(name)
    return Constant(F.exists(c, within) if m.many else within(c))


def _range_of_ranges(name: str, b: Mapping, index: Index) -> Query:
    m = index.mappings[name]
    found = V.to_range(b, m.type)
    if found is None:
        raise RequestError(f"field {name}: no valid range")
    if not m.indexed:
        return Nothing()
    lo, hi = map(F.lit, found)
    low, high = index.column(name)["min"], index.column(name)["max"]
    meets, inside = (low <= hi) & (high >= lo), (low >= lo) & (high <= hi)
    relation = str(b.get("relation") or "").strip().lower()
    return Constant({"within": inside, "contains": (low <= lo) & (high >= hi), "crosses": meets & ~inside}.get(relation, meets))


def _geo_field(kind: str, spec: Mapping, index: Index, shaped=lambda v: True) -> tuple[str, object]:
    name = spec.get("field")
    if isinstance(name, str) and name.strip():
        value: object = spec
    else:
        name, value = next(((k, v) for k, v in spec.items() if k in index.mappings and index.mappings[k].type == "geo_point" and shaped(v)), (None, None))
        if name is None:
            raise RequestError(f"{kind} needs a geo_point field")
    if name not in index.mappings or index.mappings[name].type != "geo_point":
        raise RequestError(f"{kind}: field {name} is no geo_point")
    return name, value


def _geo_distance(spec: Mapping, index: Index) -> Query:
    name, value = _geo_field("geo_distance", spec, index)
    point = V.to_point(value.get("point", value) if value is spec else value)
    if point is None:
        raise RequestError("geo_distance needs a point")
    meters = V.to_meters(spec["distance_meters"] if "distance_meters" in spec else spec.get("distance"))
    if not index.mappings[name].indexed:
        return Nothing()
    lat, lon = map(math.radians, point)
    c = index.column(name)
    # a band of latitude that holds the circle comes first: it needs no trigonometry and can be pushed to the scan
    reach = math.degrees(meters / V.EARTH_M) + 1e-9
    band = c["lat"].between(point[0] - reach, point[0] + reach)
    h = F.pow(F.sin((F.radians(c["lat"]) - lat) / 2), 2) + math.cos(lat) * F.cos(F.radians(c["lat"])) * F.pow(F.sin((F.radians(c["lon"]) - lon) / 2), 2)
    return Constant(band & (2 * V.EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0)))) <= meters))


def _geo_box(spec: Mapping, index: Index) -> Query:
    name, box = _geo_field("geo_bounding_box", spec, index, lambda v: isinstance(v, Mapping))
    top, bottom, left, right = (V.to_double(box.get(k)) for k in ("top", "bottom", "left", "right"))
    if corner := V.to_point(box.get("top_left")):
        top, left = corner
    if corner := V.to_point(box.get("bottom_right")):
        bottom, right = corner
    if None in (top, bottom, left, right):
        raise RequestError("geo_bounding_box needs top, bottom, left and right")
    if not index.mappings[name].indexed:
        return Nothing()
    c = index.column(name)
    across = (c["lon"] >= left) | (c["lon"] <= right) if left > right else c["lon"].between(left, right)
    return Constant(c["lat"].between(bottom, top) & across)


_KINDS = {"ids": _ids, "term": _term, "terms": _terms, "prefix": _prefix, "exists": _exists, "match": _match, "bool": _bool, "range": _range, "geo_distance": _geo_distance, "geo_bounding_box": _geo_box}


def combined(left: object, right: object) -> Mapping:
    """Two query bodies as one filter; a list stands for the conjunction of its objects."""

    def shaped(q: object) -> Mapping:
        if isinstance(q, (list, tuple)) and q:
            return {"bool": {"filter": [x for x in q if isinstance(x, Mapping)]}}
        return q if isinstance(q, Mapping) else {}

    a, b = shaped(left), shaped(right)
    return {"bool": {"filter": [a, b]}} if a and b else a or b
