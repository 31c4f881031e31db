"""Field mappings: what type a field of a document has and which columns hold it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

from docmill.errors import Conflict, RequestError

LONGS, DOUBLES, DATES = ("long", "integer"), ("double", "float"), ("date", "date_nanos")
LONG_RANGES, DOUBLE_RANGES = ("long_range", "integer_range", "date_range"), ("double_range", "float_range")
VECTORS = ("dense_vector", "byte_vector")
TYPES = ("keyword", "text", *LONGS, *DOUBLES, "boolean", *VECTORS, *DATES, "ip", "binary", "geo_point", *LONG_RANGES, *DOUBLE_RANGES, "ip_range")
SIMILARITIES = ("cosine", "dot_product", "euclidean", "maximum_inner_product")
#: Types whose values are also kept as a column to sort by and aggregate over, unless a mapping says otherwise.
COLUMNAR = ("keyword", *LONGS, *DATES, *DOUBLES, "boolean", "ip", "binary", "geo_point")
#: Types of which a document may hold several values.
MULTIPLE = ("keyword", *LONGS, *DOUBLES, "boolean", *DATES, "ip", "binary")

_SCALARS: dict[str, T.DataType] = {
    **dict.fromkeys(("keyword", "text"), T.StringType()),
    **dict.fromkeys((*LONGS, *DATES), T.LongType()),
    **dict.fromkeys(DOUBLES, T.DoubleType()),
    "boolean": T.BooleanType(),
    **dict.fromkeys(("ip", "binary"), T.BinaryType()),
    "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "dense_vector": T.ArrayType(T.FloatType()),
    "byte_vector": T.ArrayType(T.ByteType()),
    **{k: T.StructType([T.StructField("min", e), T.StructField("max", e)]) for ks, e in ((LONG_RANGES, T.LongType()), (DOUBLE_RANGES, T.DoubleType()), (("ip_range",), T.BinaryType())) for k in ks},
}


def _name(value: str | None, default: str) -> str:
    return value.strip().lower() if value and value.strip() else default


@dataclass(frozen=True)
class FieldMapping:
    """One field's type and options; unset ones take the type's defaults."""

    type: str | None = "keyword"
    dimension: int | None = None
    similarity: str | None = "cosine"
    indexed: bool | None = True
    stored: bool | None = True
    doc_values: bool | None = None
    multi_valued: bool | None = False
    analyzer: str | None = None
    search_analyzer: str | None = None

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("type", _name(self.type, "keyword"))
        put("similarity", _name(self.similarity, "cosine"))
        for k, default in (("indexed", True), ("stored", True), ("doc_values", self.type in COLUMNAR), ("multi_valued", False)):
            if getattr(self, k) is None:
                put(k, default)
        for k in ("analyzer", "search_analyzer"):
            put(k, (getattr(self, k) or "").strip() or None)
        if self.vector and (self.dimension is None or self.dimension <= 0):
            raise RequestError(f"a {self.type} field needs a positive dimension")
        if self.type not in TYPES:
            raise RequestError(f"no mapping type is called {self.type}")
        if self.vector and self.similarity not in SIMILARITIES:
            raise RequestError(f"no vector similarity is called {self.similarity}")

    @property
    def vector(self) -> bool:
        return self.type in VECTORS

    @property
    def many(self) -> bool:
        return bool(self.multi_valued) and self.type in MULTIPLE

    @property
    def column_type(self) -> T.DataType:
        scalar = _SCALARS[self.type]
        return T.ArrayType(scalar) if self.many else scalar


Mappings = Mapping[str, FieldMapping]


def parse(body: Mapping) -> dict[str, FieldMapping]:
    """The mappings in a request body, under mappings.properties, mappings or properties."""
    inner = body.get("mappings") if isinstance(body.get("mappings"), Mapping) else {}
    fields = inner["properties"] if isinstance(inner.get("properties"), Mapping) else inner
    if not fields and isinstance(body.get("properties"), Mapping):
        fields = body["properties"]

    def first(spec: Mapping, kind: type | tuple, *keys: str):
        value = next((spec[k] for k in keys if k in spec), None)
        if kind is str:
            return None if value is None else str(value)
        if isinstance(value, bool) is not (kind is bool):
            return None
        return value if isinstance(value, kind) else None

    if taken := [n for n in fields if n.startswith("_")]:
        raise RequestError(f"names that start with an underscore are the engine's: {', '.join(taken)}")
    return {
        name: FieldMapping(
            type=first(spec, str, "type"),
            dimension=first(spec, int, "dimension", "dims"),
            similarity=first(spec, str, "similarity"),
            indexed=first(spec, bool, "indexed", "index"),
            stored=first(spec, bool, "stored", "store"),
            doc_values=first(spec, bool, "doc_values", "docValues"),
            multi_valued=first(spec, bool, "multi_valued", "multiValued"),
            analyzer=first(spec, str, "analyzer"),
            search_analyzer=first(spec, str, "search_analyzer", "searchAnalyzer"),
        )
        for name, spec in fields.items()
        if isinstance(spec, Mapping)
    }


def extended(old: Mappings, new: Mappings) -> dict[str, FieldMapping]:
    """old with the fields of new; a field that has another mapping already is a conflict."""
    for name, mapping in new.items():
        if name in old and old[name] != mapping:
            raise Conflict(f"field {name} is mapped otherwise already")
    return {**old, **new}


def schema(mappings: Mappings) -> T.StructType:
    """The columns of the mapped fields, each with its options as metadata."""
    return T.StructType([T.StructField(n, m.column_type, metadata={k: v for k, v in vars(m).items() if v is not None}) for n, m in mappings.items()])
