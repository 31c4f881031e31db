"""Analyzers: text to tokens, as a column expression for documents and as a Python function for queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.errors import RequestError

STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_TOKENS = T.ArrayType(T.StringType())
_WORDS, _LETTERS = r"[\p{L}\p{M}\p{N}_]+", r"\p{L}+"


@dataclass(frozen=True)
class Analyzer:
    column: Callable[[Column], Column]
    tokens: Callable[[str], list[str]]


def _found(pattern: str, c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def _without_stops(c: Column) -> Column:
    return F.filter(c, lambda x: ~x.isin(*STOP_WORDS))


def _lists(lengths: pa.Array, values: list[pa.Array]) -> pa.Array:
    """Lists of the given lengths (null for a null list) of the values, one after the other."""
    ends = pc.cumulative_sum(pc.fill_null(lengths, 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pa.concat_arrays([pa.array([], pa.string()), *values]), mask=lengths.is_null())


def _stems_of(words: pa.Array) -> pa.Array:
    """The stem of each word, found once for each different one of 65,536 words: a batch's words are never all objects of Python."""
    coded = words.dictionary_encode()
    return pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(_TOKENS)
def _stems(tokens: pa.Array) -> pa.Array:
    words = tokens.flatten()
    return _lists(pc.list_value_length(tokens), [_stems_of(words.slice(at, 1 << 16)) for at in range(0, len(words), 1 << 16)])


def _english_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}]+)*"), F.lit(0))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "['’]s$", "")), lambda x: ~x.isin(*STOP_WORDS))


def _english(text: str) -> list[str]:
    words = regex.findall(r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}]+)*", text.lower())
    return [stem(w) for w in (regex.sub("['’]s$", "", w) for w in words) if w not in STOP_WORDS]


_REGISTRY: dict[str, Analyzer] = {
    "standard": Analyzer(lambda c: _found(_WORDS, c), lambda s: regex.findall(_WORDS, s.lower())),
    "keyword": Analyzer(lambda c: F.when(c.isNotNull(), F.array(c)), lambda s: [s]),
    "whitespace": Analyzer(lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != ""), lambda s: s.split()),
    "simple": Analyzer(lambda c: _found(_LETTERS, c), lambda s: regex.findall(_LETTERS, s.lower())),
    "stop": Analyzer(lambda c: _without_stops(_found(_LETTERS, c)), lambda s: [t for t in regex.findall(_LETTERS, s.lower()) if t not in STOP_WORDS]),
    "english": Analyzer(lambda c: _stems(_english_words(c)), _english),
}


def register(name: str, column: Callable[[Column], Column] | None, tokens: Callable[[str], list[str]]) -> None:
    """Add an analyzer. Without a column function its tokens run in an Arrow UDF, a text at a time."""
    if column is None:

        def made(texts: pa.Array) -> pa.Array:
            found = (None if x is None else pa.array(list(tokens(x)), pa.string()) for x in (y.as_py() for y in texts))
            lists = [(None if ts is None else len(ts), ts) for ts in found]
            return _lists(pa.array([n for n, _ in lists], pa.int32()), [ts for _, ts in lists if ts is not None])

        column = F.arrow_udf(made, _TOKENS)
    _REGISTRY[_key(name)] = Analyzer(column, tokens)


def _key(name: str | None) -> str:
    return (name or "").strip().lower().replace("-", "_") or "standard"


def analyzer(name: str | None) -> Analyzer:
    """The analyzer of a name; a blank one is standard."""
    try:
        return _REGISTRY[_key(name)]
    except KeyError:
        raise RequestError(f"no analyzer is called {name}") from None


_VOWELS = "aeiou"
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out: list[str] = []
    for i, c in enumerate(w):
        out.append("v" if c in _VOWELS or c == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(w: str) -> int:
    return regex.sub("(.)\\1+", "\\1", _shape(w)).lstrip("c").count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end:
        head = w[: -len(end)]
        if _measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
            w = head
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
