"""Values in requests, coerced on the driver: numbers, dates, addresses, points, ranges, distances, durations."""

from __future__ import annotations

import base64
import binascii
import ipaddress
import math
import re
from collections.abc import Mapping
from datetime import UTC, datetime

from docmill.errors import RequestError

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
EARTH_M = 6371008.7714
_UNITS = {"km": 1000.0, "mi": 1609.344, "m": 1.0}
_SPANS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
LOWER, UPPER = ("gte", "from", "min", "lower", "gt"), ("lte", "to", "max", "upper", "lt")


def number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def text(v) -> str:
    """v as a keyword would hold it: booleans as true and false, floats with point or exponent, lists in brackets."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return _float_text(v)
    if isinstance(v, list):
        return f"[{', '.join(map(text, v))}]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}={text(x)}" for k, x in v.items()) + "}"
    return "null" if v is None else str(v)


def _float_text(v: float) -> str:
    if math.isinf(v) or math.isnan(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(v) if "e" not in repr(v) else f"{v:.17g}"
    digits, exponent = f"{v:e}".split("e")
    digits = repr(v / 10.0 ** int(exponent)) if abs(int(exponent)) < 300 else digits
    short = repr(v).split("e")[0] if "e" in repr(v) else digits
    return f"{short if '.' in short else short + '.0'}E{int(exponent)}"


def wrapped(v: int) -> int:
    """v as a 64-bit number that overflows."""
    return (v + (1 << 63)) % (1 << 64) - (1 << 63)


def to_long(v) -> int | None:
    if number(v):
        return max(LONG_MIN, min(LONG_MAX, math.trunc(v))) if math.isfinite(v) else (0 if v != v else LONG_MAX if v > 0 else LONG_MIN)
    if isinstance(v, str) and re.fullmatch(r"[+-]?[0-9]+", v.strip()) and LONG_MIN <= int(v) <= LONG_MAX:
        return int(v)
    return None


def to_double(v) -> float | None:
    if number(v):
        return float(v)
    if isinstance(v, str):
        if m := re.fullmatch(r"([+-]?)(?:(NaN|Infinity)|((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[dDfF]?)", v.strip()):
            return float(m[1] + (m[2] or m[3]))
    return None


_INSTANT = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:\d\d(?::\d\d)?)")


def to_date(v, nanos: bool = False) -> int | None:
    """Epoch millis (or nanos) of a number, a numeric string, an instant, an offset date-time or a day; None if it is none of these."""
    if number(v):
        return to_long(v)
    if not isinstance(v, str) or not v.strip():
        return None
    s = v.strip()
    if re.fullmatch(r"[+-]?[0-9]+", s):
        return to_long(s)
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
            at, rest = datetime.fromisoformat(s).replace(tzinfo=UTC), 0
        elif _INSTANT.fullmatch(s):
            fraction = (m[1] if (m := re.search(r"\.(\d+)", s)) else "").ljust(9, "0")
            at, rest = datetime.fromisoformat(re.sub(r"\.\d+", "", s).replace("Z", "+00:00")), int(fraction or 0)
        else:
            return None
    except ValueError:
        return None
    seconds = round((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds())
    if nanos:
        whole = seconds * 1_000_000_000 + rest
        return whole if LONG_MIN <= whole <= LONG_MAX else None
    return seconds * 1000 + rest // 1_000_000


def to_ip(v) -> bytes | None:
    """The 16 bytes of a literal address; one of version 4 is mapped."""
    try:
        a = ipaddress.ip_address(str(v).strip())
    except ValueError:
        return None
    return a.packed if a.version == 6 else b"\0" * 10 + b"\xff\xff" + a.packed


def to_binary(v) -> bytes | None:
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, str):
        try:
            return base64.b64decode(v, validate=True)
        except binascii.Error:
            return None
    if isinstance(v, list) and all(number(x) and -128 <= x <= 255 for x in v):
        return bytes(int(x) % 256 for x in v)
    return None


def to_point(v) -> tuple[float, float] | None:
    """(lat, lon) of an object, a list with lat first, or "lat,lon"."""
    if isinstance(v, Mapping):
        pair = [v.get("lat"), v.get("lon", v.get("lng"))]
    elif isinstance(v, (list, tuple)):
        pair = list(v[:2])
    elif isinstance(v, str):
        pair = v.split(",")
    else:
        return None
    found = [to_double(x) for x in pair]
    if len(found) != 2 or None in found or not (-90 <= found[0] <= 90 and -180 <= found[1] <= 180):
        return None
    return found[0], found[1]


def bounds(v) -> tuple[object, object, bool, bool] | None:
    """Lower and upper value of a range and whether each is exclusive."""
    if isinstance(v, (list, tuple)):
        return (v[0], v[1], False, False) if len(v) == 2 else None
    if not isinstance(v, Mapping):
        return None
    low, high = next((k for k in LOWER if k in v), None), next((k for k in UPPER if k in v), None)
    return (v.get(low) if low else None, v.get(high) if high else None, low == "gt", high == "lt")


def to_range(v, kind: str) -> tuple | None:
    """min and max, both inside, of a range value of a range type; None if it is no range or empty."""
    b = bounds(v)
    if b is None:
        return None
    low, high, above, below = b
    if kind == "ip_range":
        lo = to_ip(low) if low is not None else b"\0" * 16
        hi = to_ip(high) if high is not None else b"\xff" * 16
        if lo is None or hi is None:
            return None
        lo = next_ip(lo, 1) if above else lo
        hi = next_ip(hi, -1) if below else hi
    elif kind in ("double_range", "float_range"):
        lo = to_double(low) if low is not None else -math.inf
        hi = to_double(high) if high is not None else math.inf
        if lo is None or hi is None:
            return None
        lo = math.nextafter(lo, math.inf) if above else lo
        hi = math.nextafter(hi, -math.inf) if below else hi
    else:
        parse = to_date if kind == "date_range" else to_long
        lo = parse(low) if low is not None else LONG_MIN
        hi = parse(high) if high is not None else LONG_MAX
        if lo is None or hi is None:
            return None
        lo, hi = wrapped(lo + above), wrapped(hi - below)
    return (lo, hi) if lo <= hi else None


def next_ip(a: bytes, step: int) -> bytes:
    return max(0, min((1 << 128) - 1, int.from_bytes(a) + step)).to_bytes(16)


def to_meters(v) -> float:
    if number(v):
        return float(v)
    s = str(v or "").strip().lower()
    for unit, factor in _UNITS.items():
        if s.endswith(unit) and (x := to_double(s[: -len(unit)])) is not None:
            return x * factor
    if (x := to_double(s)) is None:
        raise RequestError(f"no distance: {v}")
    return x


def to_millis(v) -> int:
    """A duration: a number of millis, or a number with ms, s, m, h or d."""
    if number(v):
        return int(v)
    if m := re.fullmatch(r"([0-9]+)\s*(ms|s|m|h|d)?", str(v or "").strip().lower()):
        return int(m[1]) * _SPANS[m[2] or "ms"]
    raise RequestError(f"no duration: {v}")
