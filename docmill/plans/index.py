"""A view of documents that queries run over: system columns, a typed column for each mapped field, tokens on demand."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import columns as C
from docmill.functions.analysis import analyzer
from docmill.mapping import FieldMapping, Mappings

SYSTEM = ("_id", "_index", "_shard", "_seq", "_source", "_field_names")


def shard(key: Column, shards: int, index: str) -> Column:
    """crc32 of the routing key's bytes, modulo shards; a blank key gives way to the index's name."""
    return F.pmod(F.crc32(F.when(F.trim(key) == "", F.lit(index)).otherwise(F.coalesce(key, F.lit(index))).cast("binary")), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Index:
    """Documents with the mappings of their fields. exact holds the fields whose every value of a row is in its column."""

    name: str
    mappings: Mappings
    docs: DataFrame
    shards: int = 1
    exact: frozenset[str] = field(default_factory=frozenset)

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def tokens(self, name: str) -> Column:
        """The analysed tokens of a text field: the column that ingestion stored, or computed here."""
        stored = f"_tok_{name}"
        return F.col(f"`{stored}`") if stored in self.docs.columns else analyzer(self.mappings[name].analyzer).column(self.column(name))


def of_columns(df: DataFrame, id_col: str, mappings: Mapping[str, FieldMapping], name: str = "docs", shards: int = 1, routing: str | None = None) -> Index:
    """An index over a table as it lies: fields are its columns, _source their JSON (made only where it is read)."""
    typed = [F.col(f"`{n}`").cast(m.column_type).alias(n) for n, m in mappings.items()]
    key = F.col(f"`{routing or id_col}`").cast("string")
    view = df.select(
        F.col(f"`{id_col}`").cast("string").alias("_id"),
        F.lit(name).alias("_index"),
        (shard(key, shards, name) if shards > 1 else F.lit(0)).alias("_shard"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_source"),
        F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in mappings] or [F.lit(None).cast("string")])).alias("_field_names"),
        *typed,
    )
    return Index(name, dict(mappings), view, shards, frozenset(mappings))


def of_sources(df: DataFrame, mappings: Mapping[str, FieldMapping]) -> DataFrame:
    """_id, _index, _shard, _seq, _source as given, with the columns of mapped fields, their tokens, _field_names and _error (null for a valid document).

    _error tells of JSON that is no object and of the first field whose value its type refuses.
    """
    parsed = df.withColumn("__v", F.try_parse_json("_source"))
    # what parses and begins with a brace is an object: its kind would name every key of it
    shaped = F.col("__v").isNotNull() & F.coalesce(F.col("_source").rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    # each value is looked up once, not once for each form that it may have
    fields = parsed.withColumns({f"__v_{i}": C.field(F.col("__v"), n) for i, n in enumerate(mappings)}) if mappings else parsed
    variants = {n: F.col(f"__v_{i}") for i, n in enumerate(mappings)}
    values = {n: C.coerced(variants[n], m) for n, m in mappings.items()}
    typed = fields.withColumns({n: v for n, v in values.items()}) if values else fields
    wrong = [F.when(C.invalid(variants[n], F.col(f"`{n}`"), m), F.lit(f"field {n}: no valid {m.type}")) for n, m in mappings.items()]
    names = F.array_compact(F.array(*[F.when(C.present(variants[n]), F.lit(n)) for n in mappings])) if mappings else F.array().cast("array<string>")
    made = typed.withColumns({"_field_names": names, "_error": F.coalesce(F.when(~shaped, F.lit("the document is no JSON object")), *wrong, F.lit(None).cast("string"))})
    tokens = {f"_tok_{n}": analyzer(m.analyzer).column(F.col(f"`{n}`")) for n, m in mappings.items() if m.type == "text" and m.indexed}
    return (made.withColumns(tokens) if tokens else made).drop("__v", *[f"__v_{i}" for i in range(len(mappings))])
