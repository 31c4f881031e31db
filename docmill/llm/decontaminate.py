"""Benchmark passages in documents, by one Aho-Corasick automaton over the benchmark's words.

Texts are normalised to lower-case words, and these to numbers. A window, ten consecutive words of an item, holds five
that begin at a place of the item divisible by six. Of each item of ten words or more only such fives are patterns, a
twelfth of the states that all its windows would take; of shorter items all words are. A document is scanned once,
whatever the number of patterns. A five that is found is extended on both sides along the item: ten equal words in a row
or more are windows, all of them. Word numbers are mapped to offsets in the original.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm._util import annotate, released, written

WINDOW, ANCHOR = 10, 5
#: An anchor begins at every so many words: then each window holds a whole one.
STEP = WINDOW - ANCHOR + 1
#: Bytes of item text of which one automaton is made; a larger benchmark is scanned in blocks of items, one automaton each.
BLOCK_BYTES = 16 << 20
# bytes: A-Z to a-z; a-z, 0-9 and all of 0x80 and up stay; every other becomes a space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """The items' words and the patterns that lead to them. Items of equal words are one text."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.number: dict[bytes, int] = {}
        texts: dict[bytes, tuple[int, set[str]]] = {}  # by words as int32
        for i, text in items:
            known = self.number
            found = np.array([known.setdefault(w, len(known)) for w in words(text)], dtype=np.int32)
            if len(found):
                texts.setdefault(found.tobytes(), (len(found), set()))[1].add(str(i))
        self.holders: list[list[str]] = [sorted(ids) for _, ids in texts.values()]
        # all texts of ten words or more in a row, -1 around each; and where they begin
        self.row, self.starts, self.texts = array("i", [-1]), array("q"), array("q")
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        places: dict[bytes, list[int]] = {}
        width = 4 * ANCHOR
        for k, (data, (n, _)) in enumerate(texts.items()):
            if n < WINDOW:
                self.machine.add_word(tuple(np.frombuffer(data, dtype=np.int32).tolist()), (n, k))
                continue
            at = len(self.row)
            self.starts.append(at)
            self.texts.append(k)
            self.row.frombytes(data)
            self.row.append(-1)
            for a in range(0, n - ANCHOR + 1, STEP):
                places.setdefault(data[4 * a : 4 * a + width], []).append(at + a)
        for data, where in places.items():
            key = tuple(np.frombuffer(data, dtype=np.int32).tolist())
            whole = self.machine.get(key, None)
            # a five-word item may be an anchor of others
            self.machine.add_word(key, (0, np.array(where, dtype=np.int64), None if whole is None else whole[1]))
        self.empty = not texts
        if not self.empty:
            self.machine.make_automaton()
        self.np_row, self.np_starts = np.frombuffer(self.row, dtype=np.int32), np.frombuffer(self.starts, dtype=np.int64)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The word ranges that windows cover, joined, and the items."""
        if self.empty or not found:
            return [], set()
        doc = tuple(map(self.number.get, found, repeat(UNKNOWN)))
        spans: list[tuple[int, int]] = []
        held: set[int] = set()
        done: dict[int, int] = {}  # by place in the row less place in the document: to where that overlap is known
        for end, value in self.machine.iter(doc):
            if value[0]:
                spans.append((end + 1 - value[0], end + 1))
                held.add(value[1])
                continue
            if value[2] is not None:
                spans.append((end + 1 - ANCHOR, end + 1))
                held.add(value[2])
            at = end + 1 - ANCHOR
            for q in self._promising(doc, at, value[1]):
                shift = q - at
                if done.get(shift, -1) > end:
                    continue
                a, b = self._extended(doc, at, q)
                done[shift] = b
                if b - a >= WINDOW:
                    spans.append((a, b))
                    held.add(self.texts[int(np.searchsorted(self.np_starts, q, "right")) - 1])
        return _union(spans), {i for k in held for i in self.holders[k]}

    def _promising(self, doc: tuple, at: int, where: np.ndarray) -> list[int]:
        """The places of an anchor where enough words around it are equal, too."""
        if len(where) <= 8:
            return where.tolist()
        room = WINDOW - ANCHOR
        equal = np.zeros((2, len(where)), dtype=np.int64)
        for side, (here, there, step) in enumerate(((at - 1, where - 1, -1), (at + ANCHOR, where + ANCHOR, 1))):
            alive = np.arange(len(where))
            for k in range(room):
                i = here + step * k
                if not 0 <= i < len(doc) or not len(alive):
                    break
                alive = alive[self.np_row[there[alive] + step * k] == doc[i]]
                equal[side, alive] += 1
        return where[equal.sum(0) >= room].tolist()

    def _extended(self, doc: tuple, at: int, q: int) -> tuple[int, int]:
        row, n = self.row, len(doc)
        a, b = at, at + ANCHOR
        shift = q - at
        while a and doc[a - 1] == row[a - 1 + shift]:
            a -= 1
        while b < n and doc[b] == row[b + shift]:
            b += 1
        return a, b


#: The number of a word that no item holds; unlike the mark between texts.
UNKNOWN = (1 << 31) - 1
_MADE: dict[str, Automaton] = {}  # a worker's one automaton, by its stamp


def _automaton(stamp: str, block: Broadcast) -> Automaton:
    if stamp not in _MADE:
        _MADE.clear()
        _MADE[stamp] = Automaton(block.value)
    return _MADE[stamp]


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text."""
    if not ranges:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def n_blocks(benchmark: DataFrame, text: str, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(1, -(-size // block_bytes))


def _block(benchmark: DataFrame, item_id: str, text: str, k: int, n: int) -> list[tuple[object, str | None]]:
    """The items of one block of n, some block_bytes of text: by a hash of their text, so that equal ones meet."""
    at: Column = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(n))
    return [tuple(r) for r in benchmark.where(at == k).select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).distinct().collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", text: str = "text", spans: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (and hit_spans, code points in the text, if spans).

    A null or wordless text has no words and no hits; null or wordless items occur nowhere; items with equal texts all
    count, rows with an equal item id once. An empty benchmark hits nothing. Texts and items of any length are read
    whole. Columns of docs named like these give way. A benchmark of more than block_bytes is scanned in blocks of
    about that size: one is on the driver and in a worker at a time, and a pass writes what it finds by row, which few
    rows have, and no text.
    """
    n, context = n_blocks(benchmark, item_text, block_bytes), docs.sparkSession.sparkContext
    range_type = T.ArrayType(T.ArrayType(T.LongType()))
    known: list[str] = []
    if n > 1:
        docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        passes = []
        for k in range(n - 1):
            stamp, block = uuid.uuid4().hex, context.broadcast(_block(benchmark, item_id, item_text, k, n))

            def found(texts: list, stamp: str = stamp, block: Broadcast = block) -> Iterator[tuple]:
                machine = _automaton(stamp, block)
                for t in texts:
                    hits, held = machine.scan(words(t))
                    yield [list(r) for r in hits], sorted(held)

            made = annotate(docs.select("__row", F.col(f"`{text}`").alias("t")), [T.StructField("hits", range_type), T.StructField("items", T.ArrayType(T.StringType()))], found, "t")
            passes.append(written(made.where("size(items) > 0").select("__row", "hits", "items"), "hits"))
            block.destroy()
            released(docs.sparkSession)
        every = passes[0]
        for p in passes[1:]:
            every = every.unionAll(p)
        by_row = every.groupBy("__row").agg(F.flatten(F.collect_list("hits")).alias("__hits"), F.flatten(F.collect_list("items")).alias("__items"))  # a row for each block at most
        docs = docs.join(by_row, "__row", "left").drop("__row")
        known = ["__hits", "__items"]
    stamp, block = uuid.uuid4().hex, context.broadcast(_block(benchmark, item_id, item_text, n - 1, n))

    def rows(texts: list, *before: list) -> Iterator[tuple]:
        machine = _automaton(stamp, block)
        for i, t in enumerate(texts):
            w = words(t)
            ranges, held = machine.scan(w)
            if before and before[0][i] is not None:
                ranges, held = _union(ranges + [tuple(r) for r in before[0][i]]), held.union(before[1][i])
            n_hit = sum(b - a for a, b in ranges)
            out = (len(w), n_hit, len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), n_hit > 0)
            yield (*out, [{"start": a, "end": b} for a, b in offsets(t, ranges)]) if spans else out

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    if spans:
        fields.append(T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    return annotate(docs, fields, rows, text, *known).drop(*known)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
doc AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM doc JOIN item USING (win, n)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN held USING (doc_id)
"""
