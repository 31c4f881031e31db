"""Aggregations over the documents that match a query, each a DataFrame.

Terms are a grouped count. All ranges and metrics of a request are conditional sums of one aggregation, so that any
number of them costs one pass and one row for each partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.errors import RequestError
from docmill.functions import columns as C
from docmill.functions import values as V
from docmill.mapping import DATES, DOUBLES, LONGS
from docmill.plans.index import Index

METRICS = ("min", "max", "sum", "avg", "value_count")


@dataclass(frozen=True)
class Aggregation:
    name: str
    type: str
    spec: Mapping


def parse(aggs: object) -> list[Aggregation]:
    """Aggregations of an object by name, or of a list of objects with a name; ones of unknown type give nothing."""
    if isinstance(aggs, Mapping):
        items: Iterable = [{**spec, "name": name} for name, spec in aggs.items() if isinstance(spec, Mapping)]
    else:
        items = aggs if isinstance(aggs, (list, tuple)) else []
    out = []
    for item in items:
        for kind in ("terms", "range", *METRICS):
            if isinstance(item, Mapping) and isinstance(item.get(kind), Mapping):
                out.append(Aggregation(str(item.get("name")), kind, item[kind]))
                break
    return out


def _field(a: Aggregation) -> str:
    name = a.spec.get("field")
    if not isinstance(name, str) or not name.strip():
        raise RequestError(f"aggregation {a.name} needs a field")
    return name


def _columnar(name: str, index: Index) -> bool:
    m = index.mappings.get(name)
    return m is not None and m.doc_values and m.type not in ("text", "geo_point")


def _variants(name: str) -> Column:
    """A field's values in the document itself, for what has no column."""
    return C.elements(C.field(F.try_parse_json("_source"), name))


def _listed(name: str, index: Index, convert) -> Column:
    c = index.column(name)
    if index.mappings[name].many:
        return F.transform(c, convert)
    return F.when(c.isNotNull(), F.array(convert(c)))


def _texts(name: str, index: Index) -> Column:
    """Each value of a document's field as bucket keys show it."""
    if not _columnar(name, index):
        return F.transform(F.filter(_variants(name), C.present), C.string)
    m = index.mappings[name]
    convert = C.ip_text if m.type == "ip" else F.base64 if m.type == "binary" else (lambda c: c.cast("string"))
    column = _listed(name, index, convert)
    return column if m.many or name in index.exact else F.coalesce(column, F.transform(F.filter(_variants(name), C.present), C.string))


def _numbers(name: str, index: Index, dates: bool = False) -> Column:
    """Each value as a double; nulls are values that are no number. dates: date texts count, as their millis or nanos."""
    m = index.mappings.get(name)
    is_date = m is not None and m.type in DATES
    if m is None or not _columnar(name, index):
        read = (lambda v: C.date(v, m.type == "date_nanos").cast("double")) if dates and is_date else C.double
        return F.transform(F.filter(_variants(name), C.present), read)
    if m.type in LONGS or m.type in DOUBLES or is_date and (dates or not m.many):
        column = _listed(name, index, lambda c: c.cast("double"))
        return column if m.many or name in index.exact else F.coalesce(column, F.transform(F.filter(_variants(name), C.present), C.double))
    if m.type == "keyword":
        return _listed(name, index, lambda c: F.when(c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(c).try_cast("double")))
    return F.array().cast("array<double>")


def _simple(name: str, index: Index) -> bool:
    """Whether a field is one number in a column and nowhere else."""
    m = index.mappings.get(name)
    return m is not None and name in index.exact and m.doc_values and not m.many and m.type in (*LONGS, *DOUBLES, *DATES)


def terms(docs: DataFrame, a: Aggregation, index: Index) -> DataFrame:
    """key, doc_count: the documents' values by how often they occur; ties by key.

    Values of one document count each, equal ones too. missing stands for documents without a value. min_doc_count and
    size apply to the whole counts.
    """
    name = _field(a)
    size, least = a.spec.get("size", 10), a.spec.get("min_doc_count", 1)
    size, least = int(size) if V.number(size) else 10, int(least) if V.number(least) else 1
    m = index.mappings.get(name)
    missing = a.spec.get("missing")
    if m is not None and name in index.exact and not m.many and _columnar(name, index) and m.type not in ("ip", "binary"):
        grouped = docs.select(index.column(name).alias("value"))
        counted = (grouped if missing is not None else grouped.where("value IS NOT NULL")).groupBy("value").agg(F.count("*").alias("doc_count"))
        key = F.col("value").cast("string")
        counted = counted.select((F.coalesce(key, F.lit(V.text(missing))) if missing is not None else key).alias("key"), "doc_count")
        if missing is not None:
            counted = counted.groupBy("key").agg(F.sum("doc_count").alias("doc_count"))
    else:
        found = F.coalesce(_texts(name, index), F.array().cast("array<string>"))
        if missing is not None:
            found = F.when(F.size(found) == 0, F.array(F.lit(V.text(missing)))).otherwise(found)
        counted = docs.select(F.explode(found).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("doc_count"))
    order = a.spec.get("order")
    by, how = next(iter(order.items())) if isinstance(order, Mapping) and order else ("_count", "desc")
    rising = str(how).lower() == "asc"
    if by == "_key":
        keys = [F.col("key").asc() if rising else F.col("key").desc()]
    else:
        keys = [F.col("doc_count").asc() if rising else F.col("doc_count").desc(), F.col("key").asc()]
    return counted.where(F.col("doc_count") >= least).orderBy(*keys).limit(max(0, size))


def _ranges(a: Aggregation, index: Index) -> list[tuple[str, object, object, float | None, float | None]]:
    name, listed = _field(a), a.spec.get("ranges")
    if not isinstance(listed, (list, tuple)) or not listed:
        raise RequestError(f"aggregation {a.name} needs ranges")
    m = index.mappings.get(name)
    out = []
    for r in listed:
        if not isinstance(r, Mapping):
            raise RequestError(f"aggregation {a.name}: a range is an object")
        ends = []
        for end in ("from", "to"):
            v = r.get(end)
            found = None if v is None else V.to_date(v, m.type == "date_nanos") if m is not None and m.type in DATES else V.to_double(v)
            if v is not None and found is None:
                raise RequestError(f"aggregation {a.name}: {end} bound {v!r} cannot be read")
            ends.append(None if found is None else float(found))
        show = lambda v: "*" if v is None else V.text(v)
        key = r.get("key")
        out.append((V.text(key) if key is not None else f"{show(r.get('from'))}-{show(r.get('to'))}", r.get("from"), r.get("to"), *ends))
    return out


def _within(x: Column, low: float | None, high: float | None) -> Column:
    test = x.isNotNull()
    if low is not None:
        test = test & (x >= low)
    return test & (x < high) if high is not None else test


def _within_bounds(low: float | None, high: float | None):
    return lambda x: _within(x, low, high)


def summary(docs: DataFrame, wanted: list[Aggregation], index: Index) -> dict[str, DataFrame]:
    """All range and metric aggregations of a request, from one row of conditional sums, which is computed here and now."""
    sums: list[Column] = []
    shapes: dict[str, list[Column]] = {}
    for i, a in enumerate(wanted):
        name = _field(a)
        simple = _simple(name, index)
        if a.type == "range":
            buckets: dict[str, tuple[object, object, list[int]]] = {}
            numbers = index.column(name).cast("double") if simple else _numbers(name, index, dates=True)
            for j, (key, low_said, high_said, low, high) in enumerate(_ranges(a, index)):
                hit = _within(numbers, low, high) if simple else F.exists(numbers, _within_bounds(low, high))
                sums.append(F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias(f"r{i}_{j}"))
                buckets.setdefault(key, (low_said, high_said, []))[2].append(j)  # ranges of one key are one bucket
            said = lambda v: F.lit(None if v is None else V.text(v)).cast("string")
            shapes[a.name] = [
                F.struct(F.lit(k).alias("key"), said(lo).alias("from"), said(hi).alias("to"), sum((F.coalesce(F.col(f"r{i}_{j}"), F.lit(0)) for j in js[1:]), F.coalesce(F.col(f"r{i}_{js[0]}"), F.lit(0))).alias("doc_count"))
                for k, (lo, hi, js) in buckets.items()
            ]
            continue
        if simple:
            x = index.column(name).cast("double")
            n, low, high, total = x.isNotNull().cast("long"), x, x, x
        else:
            x = F.filter(_numbers(name, index), lambda v: v.isNotNull())
            n, low, high = F.coalesce(F.size(x), F.lit(0)).cast("long"), F.array_min(x), F.array_max(x)
            total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        sums += [F.sum(n).alias(f"n{i}"), F.min(low).alias(f"a{i}"), F.max(high).alias(f"b{i}"), F.sum(total).alias(f"s{i}")]
        count, total_sum = F.coalesce(F.col(f"n{i}"), F.lit(0)), F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        value = {"min": F.col(f"a{i}"), "max": F.col(f"b{i}"), "sum": total_sum, "avg": F.when(count > 0, total_sum / count), "value_count": count.cast("double")}[a.type]
        extra = [total_sum.alias("sum")] if a.type == "avg" else []
        shapes[a.name] = [F.struct(F.lit(a.type).alias("type"), F.lit(name).alias("field"), value.cast("double").alias("value"), count.alias("count"), *extra)]
    if not sums:
        return {}
    found = docs.agg(*sums)
    values = found.first()
    row = docs.sparkSession.range(1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in found.schema])
    return {k: row.select(F.inline(F.array(*v))) for k, v in shapes.items()}


def aggregate(docs: DataFrame, aggs: object, index: Index) -> dict[str, DataFrame]:
    """Every aggregation of a request by name."""
    wanted = parse(aggs)
    out = {a.name: terms(docs, a, index) for a in wanted if a.type == "terms"}
    out |= summary(docs, [a for a in wanted if a.type != "terms"], index)
    return {a.name: out[a.name] for a in wanted}
