"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece's bytes there is one token with which its encoding ends. A token t that ends a prefix is
that one exactly if t may follow the last token of what is left when t is cut off, that is, if the two tokens' bytes
encoded alone give these two again. Storing the last token of every prefix gives the encoding by walking back; more
bytes only extend the table, and after an edit only what lies behind it is filled again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmill.llm._util import annotate

#: Bytes, about, of pieces and their ids that a worker remembers at most; it starts afresh when they are full. A piece of
#: more than LONG characters is not remembered. No result depends on either.
REMEMBERED, LONG = 96 << 20, 200
#: Pairs of tokens whose fit a worker remembers at most.
PAIRS = 1_000_000


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The ids of data by merging the pair of lowest rank until none is left: the definition, used for pairs of tokens."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Vocabulary:
    """The tokens of a rank file, and which may follow which."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes: dict[int, bytes] = {i: t for t, i in self.ranks.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.longest = max(map(len, self.ranks))
        self.ends = ahocorasick.Automaton()  # every token that ends at a place, the longest first
        for t, i in self.ranks.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pieces: dict[str, str] = {}  # a piece's ids as decimals, joined by spaces
        self.held = 0  # bytes of pieces, about

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives t, t twice for a single byte, None if merging t's bytes gives no single token."""
        try:
            return self.halves[t]
        except KeyError:
            pass
        data, found = self.bytes[t], (t, t)
        if len(data) > 1:
            if merge(self.ranks, data) != [t]:
                found = None
            else:
                # the last merge is the one without which two parts are left
                rest = merge({k: r for k, r in self._inside(data) if r != t}, data)
                found = (rest[0], rest[1]) if len(rest) == 2 else None
        self.halves[t] = found
        return found

    def _inside(self, data: bytes) -> Iterator[tuple[bytes, int]]:
        for i in range(len(data)):
            for j in range(i + 1, len(data) + 1):
                if (r := self.ranks.get(data[i:j])) is not None:
                    yield data[i:j], r

    def fits(self, a: int, b: int) -> bool:
        """Whether b may directly follow a in an encoding: no merge across their border comes before the merges that made them."""
        if (ok := self.follows.get((a, b))) is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            ok = self.follows[a, b] = self._fits(a, b)
        return ok

    def _fits(self, a: int, b: int) -> bool:
        if self.split(a) is None or self.split(b) is None:
            return False
        limit, ranks, text = 1 << 62, self.ranks, self.bytes
        while True:
            if ranks.get(text[a] + text[b], limit) < limit:
                return False
            if a > b:
                limit, half = a, self.split(a)[1]
                if half != a:
                    a = half
                    continue
                limit, half = b + 1, self.split(b)[0]
                if half == b:
                    return True
                b = half
            else:
                limit, half = b + 1, self.split(b)[0]
                if half != b:
                    b = half
                    continue
                limit, half = a, self.split(a)[1]
                if half == a:
                    return True
                a = half

    def extend(self, last: list[int], data: bytes, to: int | None = None) -> None:
        """Fill last, which holds the last token of each prefix (-1 for the empty one), up to data[:to]."""
        known, append = self.follows.get, last.append
        done = len(last) - 1
        base = max(0, len(last) - self.longest)
        for end, (t, n) in self.ends.iter(data[base:to].decode("latin-1")):
            end += base + 1
            if end <= done:
                continue
            before = last[end - n]
            if before < 0:
                fits = self.split(t) is not None
            elif (fits := known((before, t))) is None:
                fits = self.fits(before, t)
            if fits:
                append(t)
                done = end

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        if (t := self.ranks.get(data)) is not None:
            return [t]
        last = [-1]
        self.extend(last, data)
        return self.walk(last)

    def lines(self, found: list[str]) -> list[str]:
        """The ids of each piece as decimals, each piece encoded on its own; every new one is decoded again and compared."""
        known = self.pieces
        try:
            return list(map(known.__getitem__, found))
        except KeyError:
            pass
        if self.held > REMEMBERED:
            known.clear()
            self.held = 0
        long = {}
        for p in set(found).difference(known):
            data = p.encode("utf-8", "replace")
            ids = self.piece(data)
            if self.decode(ids) != data:
                raise ValueError(f"the vocabulary cannot encode {data!r}")
            line = " ".join(map(self.text.__getitem__, ids))
            if len(p) > LONG:
                long[p] = line
            else:
                known[p] = line
                self.held += 240 + 2 * len(p) + len(line)
        return [known.get(p) or long[p] for p in found] if long else list(map(known.__getitem__, found))

    def array(self, text: str) -> np.ndarray:
        """The ids of each match of the pattern in text, encoded on its own."""
        return numbers(" ".join(self.lines(pieces(text))))

    def encode(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id without a token is an error."""
        return b"".join(map(self.bytes.__getitem__, ids))


_PIECES = regex.compile(PATTERN).findall
# For characters that \w, \d and \s class as \p{L}, \p{N} and white space do, the standard library's expressions find
# the same pieces in two thirds of the time. The ranges leave out numbers that are no digits and some controls.
_COMMON = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]*+").fullmatch
_SAME_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
_COMMON_PIECES = re.compile(_SAME_PATTERN).findall


def pieces(text: str) -> list[str]:
    """The matches of the pattern in text."""
    return _COMMON_PIECES(text) if _COMMON(text) else _PIECES(text)


def numbers(line: str) -> np.ndarray:
    return np.fromstring(line, dtype=np.int32, sep=" ")


class Prefixes:
    """A piece whose encoding is kept while it is edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1]
        vocabulary.extend(self.last, data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(self.last, self.data)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]. What follows is filled again only until it agrees with the old table for as long as the longest token."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old[: start + 1], 0
        for at in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.last, self.data, at)
            was = at - shift
            # a prefix's last token depends on the bytes and last tokens of one longest token before it
            same = same + 1 if end < was < len(old) and old[was] == self.last[at] else 0
            if same > self.vocabulary.longest and at > start + len(new) + self.vocabulary.longest:
                self.last += old[was + 1 :]
                return

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.last)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (and token_ids, if ids), the texts encoded whole and decoded again.

    A null text is an empty one: no tokens, the hashes of no bytes. Columns of docs named like these give way. Equal
    texts get equal results; no rows give no rows; a text of any length is encoded whole. A lone surrogate, which no valid
    table holds, counts as "?".
    """

    def rows(texts: list) -> Iterator[tuple]:
        v = vocabulary(path)
        for t in texts:
            found = pieces(t or "")
            line = " ".join(v.lines(found))
            # each piece's ids were decoded to the piece, so all ids decode to all pieces
            decoded = "".join(found).encode("utf-8", "replace")
            out = (line.count(" ") + 1 if line else 0, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
            yield (*out, numbers(line)) if ids else out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return annotate(docs, fields + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids, rows, text)
