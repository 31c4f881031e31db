"""Lenient coercion of document fields, as column expressions on variants; nothing here raises on data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.values import LONG_MAX, LONG_MIN, LOWER, UPPER
from docmill.mapping import DATES, DOUBLE_RANGES, DOUBLES, LONGS, FieldMapping

#: What a value that makes its document invalid becomes an error of; the others are silently left out.
STRICT = (*DATES, "ip", "binary", "dense_vector", "byte_vector")


def field(source: Column, name: str) -> Column:
    """The variant at a top-level key of a parsed document; null if it is absent."""
    key = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(source, f"$['{key}']", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def string(v: Column) -> Column:
    """A value's text; lists as [a, b], doubles as Java writes them."""
    k, s = kind(v), F.try_variant_get(v, "$", "string")
    listed = F.concat(F.lit("["), F.array_join(F.try_variant_get(v, "$", "array<string>"), ", ", "null"), F.lit("]"))
    return F.when(~present(v), None).when(k.startswith("ARRAY"), listed).when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").cast("string")).otherwise(s)


def elements(v: Column) -> Column:
    return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(present(v), F.array(v))


def _numeric(v: Column) -> Column:
    return kind(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")


def _text(v: Column) -> Column:
    return F.when(kind(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))


def long(v: Column) -> Column:
    d = F.try_variant_get(v, "$", "double")
    cut = F.when(d.isNull() | F.isnan(d), None).when(d >= float(LONG_MAX), F.lit(LONG_MAX)).when(d <= float(LONG_MIN), F.lit(LONG_MIN)).otherwise(d.try_cast("long"))
    whole = kind(v).rlike("INT$")
    return F.when(whole, F.try_variant_get(v, "$", "bigint")).when(_numeric(v), cut).otherwise(F.when(_text(v).rlike(r"^[+-]?[0-9]+$"), _text(v).try_cast("long")))


def double(v: Column) -> Column:
    s = _text(v)
    plain = F.when(s.rlike(r"^[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?)$"), F.regexp_replace(s, "[dDfF]$", "").try_cast("double"))
    return F.when(_numeric(v), F.try_variant_get(v, "$", "double")).otherwise(plain)


def boolean(v: Column) -> Column:
    return F.when(~present(v), None).when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind(v) == "STRING", F.lower(F.try_variant_get(v, "$", "string")) == "true").when(_numeric(v), long(v) != 0).otherwise(F.lit(False))


def date(v: Column, nanos: bool = False) -> Column:
    """Epoch millis or nanos; null if the text is none of the accepted forms."""
    s = _text(v)
    day = F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.unix_seconds(F.concat(s, F.lit("T00:00:00Z")).try_cast("timestamp")))
    form = s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d(:\d\d)?)$")
    at = F.unix_seconds(F.regexp_replace(F.when(form, s), r"\.\d+", "").try_cast("timestamp"))
    rest = F.rpad(F.regexp_extract(s, r"\.(\d+)", 1), 9, "0").try_cast("long")
    if nanos:
        fits = lambda x: F.when(x.between(-9223372036, 9223372035), x * 1_000_000_000)
        text = F.coalesce(fits(day), fits(at) + rest)
    else:
        text = F.coalesce(day * 1000, at * 1000 + F.floor(rest / 1_000_000).cast("long"))
    return F.when(_numeric(v), long(v)).when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("long")).otherwise(text)


def ip(s: Column) -> Column:
    """The 16 bytes of an address literal; null if s is none."""
    four = r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$"
    hex4 = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda p: F.lpad(F.hex(p.try_cast("int")), 2, "0")), "")
    mapped = F.concat(F.lit("00000000000000000000FFFF"), hex4(s))
    # a dotted end of an IPv6 literal becomes two groups
    dotted = F.regexp_extract(s, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    groups = F.concat(F.expr("''"), F.substring(hex4(dotted), 1, 4), F.lit(":"), F.substring(hex4(dotted), 5, 4))
    flat = F.when(F.length(dotted) > 0, F.concat(F.regexp_replace(s, r"\d+\.\d+\.\d+\.\d+$", ""), groups)).otherwise(s)
    sides = F.split(flat, "::", -1)
    part = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    left, right = part(1), part(2)
    gap = F.lit(8) - F.size(left) - F.size(right)
    whole = F.when(F.size(sides) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)).otherwise(left)
    good = F.contains(s, F.lit(":")) & flat.rlike(r"^[0-9A-Fa-f:]+$") & F.when(F.size(sides) == 2, gap >= 1).otherwise((F.size(sides) == 1) & (gap == 0) & flat.rlike(r"^[0-9A-Fa-f]+(:[0-9A-Fa-f]+){7}$")) & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    six = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    return F.unhex(F.when(s.rlike(four), mapped).when(good, six))


def ip_text(b: Column) -> Column:
    """An address as text: dotted if it is a mapped version 4, else eight groups without leading zeros."""
    h = F.hex(b)
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10)
    four = F.concat_ws(".", *[byte(25 + 2 * i) for i in range(4)])
    six = F.concat_ws(":", *[F.lower(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 16)) for i in range(8)])
    return F.when(h.startswith("00000000000000000000FFFF"), four).otherwise(six)


def binary(v: Column) -> Column:
    numbers = F.transform(F.try_variant_get(v, "$", "array<double>"), lambda x: F.when(x.between(-128, 255), F.lpad(F.hex(F.pmod(x.try_cast("int"), F.lit(256))), 2, "0")))
    listed = F.when(F.forall(numbers, lambda x: x.isNotNull()), F.unhex(F.array_join(numbers, "")))
    return F.when(kind(v) == "STRING", F.try_to_binary(F.try_variant_get(v, "$", "string"), F.lit("base64"))).when(kind(v).startswith("ARRAY"), listed)


def point(v: Column) -> Column:
    inner = lambda k: double(F.try_variant_get(v, f"$.{k}", "variant"))
    item = lambda i: double(F.try_variant_get(v, f"$[{i}]", "variant"))
    halves = F.split(_text(v), ",")
    half = lambda i: F.when(F.size(halves) == 2, F.trim(F.try_element_at(halves, F.lit(i))).try_cast("double"))
    k = kind(v)
    lat = F.when(k.startswith("OBJECT"), inner("lat")).when(k.startswith("ARRAY"), item(0)).otherwise(half(1))
    lon = F.when(k.startswith("OBJECT"), F.coalesce(inner("lon"), inner("lng"))).when(k.startswith("ARRAY"), item(1)).otherwise(half(2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def range_(v: Column, type_: str) -> Column:
    """min and max, both inside; null if either bound cannot be read or nothing is between."""
    if type_ == "ip_range":
        read, low_end, high_end = (lambda x: ip(string(x))), F.unhex(F.lit("00" * 16)), F.unhex(F.lit("FF" * 16))
        up = down = lambda x: x
    elif type_ in DOUBLE_RANGES:
        read, low_end, high_end = double, F.lit(float("-inf")), F.lit(float("inf"))
        up, down = next_double
    else:
        read, low_end, high_end = (date if type_ == "date_range" else long), F.lit(LONG_MIN), F.lit(LONG_MAX)
        up = lambda x: F.when(x < LONG_MAX, x + 1)
        down = lambda x: F.when(x > LONG_MIN, x - 1)

    def bound(keys: tuple[str, ...], place: int, end: Column, shift) -> Column:
        found = F.when(kind(v).startswith("ARRAY"), read(F.try_variant_get(v, f"$[{place}]", "variant")))
        for k in keys:
            x = F.try_variant_get(v, f"$.{k}", "variant")
            found = found.when(present(x), shift(read(x)) if k in ("gt", "lt") else read(x))
        return found.otherwise(end)

    low, high = bound(LOWER, 0, low_end, up), bound(UPPER, 1, high_end, down)
    shaped = kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    return F.when(shaped & (low <= high), F.struct(low.alias("min"), high.alias("max")))


def _step(x: Column, sign: int) -> Column:
    """The double next to x: by its relative spacing, which rounds to the neighbour."""
    return F.when(x == 0, F.lit(sign * 5e-324)).when(F.abs(x) == float("inf"), x).otherwise(x + sign * F.greatest(F.abs(x) * 1.1102230246251568e-16, F.lit(5e-324)))


next_double = ((lambda x: _step(x, 1)), (lambda x: _step(x, -1)))


def vector(v: Column, dimension: int, byte: bool) -> Column:
    """The vector if it has the dimension and every component is a number in range."""
    raw = F.try_variant_get(v, "$", "array<variant>")
    good = (F.size(raw) == dimension) & F.forall(raw, lambda x: F.schema_of_variant(x).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"))
    numbers = F.transform(raw, lambda x: F.try_variant_get(x, "$", "double"))
    if byte:
        return F.when(good & F.forall(numbers, lambda x: x.between(-128, 127)), numbers.cast("array<tinyint>"))
    return F.when(good, numbers.cast("array<float>"))


def coerced(v: Column, m: FieldMapping) -> Column:
    """A field's column, of m's type, from its variant."""

    def one(x: Column) -> Column:
        if m.type in ("keyword", "text"):
            return string(x)
        if m.type in LONGS:
            return long(x)
        if m.type in DOUBLES:
            return double(x)
        if m.type == "boolean":
            return boolean(x)
        if m.type in DATES:
            return date(x, m.type == "date_nanos")
        if m.type == "ip":
            return ip(F.trim(string(x)))
        if m.type == "binary":
            return binary(x)
        if m.type == "geo_point":
            return point(x)
        if m.vector:
            return vector(x, m.dimension, m.type == "byte_vector")
        return range_(x, m.type)

    if not m.many:
        return one(v)
    return F.filter(F.transform(elements(v), one), lambda x: x.isNotNull())


def invalid(v: Column, value: Column, m: FieldMapping) -> Column:
    """Whether a present value makes its document invalid."""
    if m.type not in STRICT:
        return F.lit(False)
    if m.many:
        return present(v) & (F.size(F.filter(elements(v), present)) != F.size(value))
    return present(v) & value.isNull()
