"""Sort orders, cursors and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.errors import RequestError
from docmill.functions import values as V
from docmill.mapping import DATES, DOUBLES, LONGS
from docmill.plans.index import Index


@dataclass(frozen=True)
class Key:
    """One sort key: its value, direction, the kind its cursor values have, and where missing ones go."""

    field: str
    value: Column
    descending: bool
    kind: str
    nulls_first: bool = False

    def order(self) -> Column:
        if self.descending:
            return self.value.desc_nulls_first() if self.nulls_first else self.value.desc_nulls_last()
        return self.value.asc_nulls_first() if self.nulls_first else self.value.asc_nulls_last()

    def shown(self, v: str | None) -> object:
        """A sort value, given as text, as a response has it."""
        return v if v is None or self.kind == "string" else float(v) if self.kind == "double" else int(v)

    def read(self, v: object):
        """A cursor value, coerced to the key's kind."""
        if v is None:
            return None
        read = {"long": V.to_long, "double": V.to_double, "date": V.to_date, "date_nanos": lambda x: V.to_date(x, True)}.get(self.kind, V.text)
        if (found := read(v)) is None:
            raise RequestError(f"search_after: {v!r} is no value of {self.field}")
        return found

    def beyond(self, v: object) -> Column:
        """Whether a row comes strictly after cursor value v in this key."""
        if v is None:  # nulls are last, or first if descending
            return self.value.isNotNull() if self.nulls_first else F.lit(False)
        past = self.value < F.lit(v) if self.descending else self.value > F.lit(v)
        return F.coalesce(past, F.lit(not self.nulls_first))

    def level(self, v: object) -> Column:
        return self.value.eqNullSafe(F.lit(v))


def parse(spec: object) -> list[tuple[str, bool]]:
    """(field, descending) of a sort: a list of names and objects, an object, or a name; of an object the first key counts."""
    items = spec if isinstance(spec, (list, tuple)) else [spec]
    out = []
    for item in items:
        if isinstance(item, str):
            name, how = item, {}
        elif isinstance(item, Mapping) and item:
            name, how = next(iter(item.items()))
        else:
            continue
        order = how.get("order") if isinstance(how, Mapping) else how
        out.append((name, str(order).lower() == "desc" if isinstance(order, str) and order.strip() else name == "_score"))
    return out


def keys(spec: object, index: Index) -> list[Key]:
    found = []
    for name, descending in parse(spec):
        if name == "_score":
            found.append(Key(name, F.col("_score"), descending, "double"))
            continue
        if name == "_id":
            found.append(Key(name, F.col("_id"), descending, "string", descending))
            continue
        m = index.mappings.get(name)
        if m is None:
            raise RequestError(f"sort: field {name} is not mapped")
        if not m.doc_values:
            raise RequestError(f"sort: field {name} has no doc values")
        c = index.column(name)
        if m.type in ("keyword", "boolean"):
            c = c.cast("array<string>" if m.many else "string")
        if m.many:
            c = F.array_max(c) if descending else F.array_min(c)
        if m.type in ("keyword", "boolean"):
            found.append(Key(name, c, descending, "string", descending))
        elif m.type in LONGS or m.type in DATES:
            end = V.LONG_MIN if descending else V.LONG_MAX
            found.append(Key(name, F.coalesce(c, F.lit(end)), descending, m.type if m.type in DATES else "long"))
        elif m.type in DOUBLES:
            end = float("-inf") if descending else float("inf")
            found.append(Key(name, F.coalesce(c, F.lit(end)), descending, "double"))
        else:
            raise RequestError(f"sort does not work on field {name}")
    return found


def page(hits: DataFrame, by: Sequence[Key], start: int, size: int, after: Sequence | None = None) -> DataFrame:
    """A page of hits with rank (from 1) and sort_values, as text; ties go by score, then _id.

    Without keys the order is by score. A page is one ordered limit: no more than start + size rows of a partition are
    kept at any time.
    """
    if after:
        if not by:
            raise RequestError("search_after needs a sort")
        if len(after) != len(by):
            raise RequestError("search_after needs a value for each sort key")
        read = [k.read(v) for k, v in zip(by, after)]
        tests = [reduce(lambda a, b: a & b, [k.level(v) for k, v in zip(by[:i], read)] + [by[i].beyond(read[i])]) for i in range(len(by))]
        hits, start = hits.where(reduce(lambda a, b: a | b, tests)), 0
    order = [k.order() for k in by] + [F.col("_score").desc(), F.col("_id").asc()]
    shown = F.array(*[k.value.cast("string") for k in by]) if by else F.array().cast("array<string>")
    ordered = hits.withColumn("sort_values", shown).orderBy(*order)
    return ordered.offset(max(0, start)).limit(max(0, size)) if start > 0 else ordered.limit(max(0, size))
