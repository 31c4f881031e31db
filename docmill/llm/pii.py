"""Personal data in text: regular expressions propose, checksums confirm, nearby words adjust the score.

Four kinds (email, ip, card, phone) are found by fixed rules and always kept. Three more are proposed by looser
expressions and kept at a score of KEEP or more; they never touch a span of the four. A span starts at its kind's score,
an ``iban`` whose digits are 1 mod 97 with 0.6 more. A word of its kind within 40 code points adds the kind's gain, one
that speaks of orders, versions or the like takes 0.2; scores end at 0 and 1.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm._util import annotate

KINDS = ("email", "ip", "card", "phone", "iban", "national", "ssn")
KEEP = 0.6
NEAR = 40

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# where the first digit of a run fails, so does every later one: a match can be sought at the first only
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
#: What a kind starts at, and what a word of its kind adds.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.3, "national": 0.4, "ssn": 0.4}
GAIN = {"email": 0.2, "ip": 0.3, "card": 0.2, "phone": 0.3, "iban": 0.1, "national": 0.3, "ssn": 0.3}
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|courriel|correo|adresse|address|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|ipv4|host|server|address|adresse|login|client|from)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|payment|pay|carte|karte|tarjeta)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta|transfer|bic|swift)\b", re.I),
    "phone": (_TELEPHONE := re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|contact|téléphone|telefon|teléfono|handy)\b", re.I)),
    "national": _TELEPHONE,
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer|tax id)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:order|invoice|version|isbn|serial|part|sku|ticket)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of the email expression: it is tried only where a run of local characters before an at sign begins."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed kinds, by start, then kind as listed."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def score(text: str, kind: str, a: int, b: int, extra: float = 0.0) -> float:
    """A span's score, from its kind and the words within NEAR code points of it."""
    around = text[max(0, a - NEAR) : a] + "\n" + text[b : b + NEAR]
    s = START[kind] + extra + GAIN[kind] * bool(_CONTEXT[kind].search(around)) - 0.2 * bool(_AGAINST.search(around))
    return round(min(1.0, max(0.0, s)), 2)


def more(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """The method's own spans outside taken, with their scores."""
    out: list[tuple[str, int, int, float]] = []
    if not _DIGIT.search(text):
        return out
    busy: list[tuple[int, int]] = []  # disjoint, in order
    for _, a, b in taken:
        if busy and a < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(b, busy[-1][1]))
        else:
            busy.append((a, b))
    for kind, expression in (("iban", _IBAN), ("national", _NATIONAL), ("ssn", _SSN)):
        for m in expression.finditer(text):
            a, b = m.span()
            at = bisect_left(busy, (b,))  # those before begin before b
            if at and busy[at - 1][1] > a:
                continue
            s = score(text, kind, a, b, 0.6 * (kind == "iban" and mod97(m.group())))
            if s >= KEEP:
                out.append((kind, a, b, s))
                insort(busy, (a, b))
    return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans and scores (of the spans, in order).

    Whole texts of any length; a null text is an empty one, without spans. A base span is kept at any score. Columns of docs named like these
    give way; equal texts get equal results; no rows give no rows.
    """

    def rows(texts: list) -> Iterator[tuple]:
        for t in texts:
            t = t or ""
            fixed = base(t)
            added = more(t, fixed)
            n = [sum(k == x for k, _, _ in fixed) for x in KINDS[:4]]
            every = sorted([(k, a, b, score(t, k, a, b)) for k, a, b in fixed] + added, key=lambda s: (s[1], KINDS.index(s[0])))
            yield (*n, hashlib.sha256(_line(fixed).encode()).hexdigest(), _line([s[:3] for s in every]), ",".join(f"{s[3]:g}" for s in every))

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "scores")]
    return annotate(docs, fields, rows, text)


def masked(text: str | None) -> str | None:
    """text with each group of overlapping spans replaced by its first kind in angle brackets."""
    if not text:
        return text
    fixed = base(text)
    spans = sorted(fixed + [s[:3] for s in more(text, fixed)], key=lambda s: (s[1], KINDS.index(s[0])))
    out, done = [], 0
    joined: list[list] = []
    for k, a, b in spans:
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
        else:
            joined.append([k, a, b])
    for k, a, b in joined:
        out += [text[done:a], f"<{k.upper()}>"]
        done = b
    return "".join(out) + text[done:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text masked; null stays null and the columns stay in place."""

    def rows(texts: list) -> Iterator[tuple]:
        return ((masked(t),) for t in texts)

    made = annotate(docs, [T.StructField("__masked", T.StringType())], rows, text)
    return made.select(*[made["__masked"].alias(c) if c == text else made[f"`{c}`"] for c in docs.columns])
