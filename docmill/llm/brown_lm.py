"""Scores of texts by a class-based bigram model whose classes come from exchange clustering.

log P(text) is the sum over tokens of log P(class | class before) + log P(word | class); a text starts after an end and
ends with one. Every training word is assigned by exchange. The ``SEEDS`` most frequent words start it, moved one at a
time. Then rounds over all texts count the neighbouring classes of each of the ``CLUSTERED`` most frequent words and
move it to the class that raises the training likelihood most, the others held fixed; the likeliest round is kept. All
other training words, counted with their neighbours among these in a shuffle, are inserted where exchange would put
them. Classes are as many as the cube root of the distinct training words, ``CLASSES`` at least.

A word not seen in training is in one of ``TAILS`` classes by its last three bytes, whose transitions are those of the
words that occur once: of the count of such a word its class keeps a share only and its tail class, for what is new, gets
the discount.

Counts and classes of the hot words are sent to every worker; the rest, which grow with the corpus, go to a bucket of
words with their neighbours, once for each slice of texts that holds them, and from there their counts and classes go back.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm._util import dropped, merged, released, remainder, written

SEEDS, CLUSTERED, CLASSES, TAILS, HOT = 1000, 200_000, 48, 64, 200_000
#: Rounds that move the clustered words; after the first, each moves a half of them, so that neighbours don't change places for ever.
ROUNDS = 3
#: A word longer than this is never hot: so HOT bounds the bytes sent, too.
HOT_BYTES = 64
#: Buckets of words that aren't hot; more of them only if each got over BUCKET_WORDS words of slices.
BUCKETS, BUCKET_WORDS = 256, 250_000
_BLOCK = 512  # hot words whose neighbours' counts travel in a row
#: Tokens at which a slice of encoded texts ends; a longer text is a slice of its own.
SLICE_TOKENS = 1 << 17
_END = b"\x00"  # stands for the end in counts; no word can be it, see _named
_CHUNK = 1 << 22  # bytes of text that are split at a time
#: Bytes of a batch that goes to a worker: one of texts is a chunk, if its last text is not too long.
LOT = _CHUNK * 15 // 16
#: Slices that are read, or in a page of a file, at a time. One has some MB.
LOT_SLICES = 8


@contextmanager
def _lots(spark: SparkSession) -> Iterator[None]:
    """Jobs in here send batches of some LOT bytes, of a row at least. By Spark's limit of 64 MB a batch is most of a
    partition, which an executor holds outside its heap for each of its tasks."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": str(LOT), "spark.sql.parquet.columnarReaderBatchSize": str(LOT_SLICES)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    with _lots(df.sparkSession):
        return written(df, name, **options)


def _stored_slices(df: DataFrame, name: str) -> DataFrame:
    """A page of a column would else be all slices of a file."""
    return _stored(df, name, **{"parquet.page.row.count.limit": LOT_SLICES})


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some _CHUNK bytes of the text in a column, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()
            at = to


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lowered, cut at ASCII white space; how many each text has. A null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # before leading and after trailing space there is an empty one
    if not pc.all(full).as_py():
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        words, sizes = words.filter(full), np.diff(kept[np.concatenate([[0], np.cumsum(sizes)])])
    return words.cast(pa.binary()), sizes


def _named(words: pa.Array) -> list[bytes]:
    """Words as bytes. A word that starts with a zero byte gets another, so that none is the end."""
    return [b"\x00" + w if w[:1] == b"\x00" else w for w in words.to_pylist()]


def _tail(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often it occurs in docs' text, the end once a row. Each worker sums before it sends: a chunk of text, then Spark its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 0):
            found = _words(part.column(0))[0].value_counts()
            words = found.field("values")
            if pc.any(pc.starts_with(words, pattern=_END)).as_py():
                words = pa.array(_named(words), pa.binary())
            yield pa.RecordBatch.from_arrays([words, found.field("counts")], names=["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([_END], pa.binary()), pa.array([part.num_rows], pa.int64())], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def exchange(n: np.ndarray, words: int, classes: int, rounds: int = 6) -> np.ndarray:
    """Classes of the first words units, given bigram counts of all units; each further unit is a class of its own.

    Words start in turn by frequency. A round moves each word, the most frequent first, to the class at which
    sum f(N(a, b)) - sum f(N(a, .)) - sum f(N(., b)), f(x) = x log x, is largest; rounds end when none moves.
    """
    units = len(n)
    of = np.concatenate([np.arange(words) % classes, classes + np.arange(units - words)])
    total = classes + units - words
    table = np.zeros((total, total))
    np.add.at(table, (of[:, None], of[None, :]), n)
    left, right = n.sum(1).astype(float), n.sum(0).astype(float)
    size_l, size_r = table.sum(1), table.sum(0)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(rounds):
        moved = 0
        for w in range(words):
            a = of[w]
            after, before = np.bincount(of, weights=n[w], minlength=total), np.bincount(of, weights=n[:, w], minlength=total)
            loop = float(n[w, w])
            after[a] -= loop
            before[a] -= loop
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= loop
            size_l[a] -= left[w]
            size_r[a] -= right[w]
            row, col = table[:classes], table[:, :classes].T
            gain = (f(row + after) - f(row)).sum(1) + (f(col + before) - f(col)).sum(1)
            own = np.arange(classes)
            d = table[own, own]  # the diagonal takes both sides and the loop at once
            gain += f(d + after[own] + before[own] + loop) - f(d + after[own]) - f(d + before[own]) + f(d)
            gain -= f(size_l[:classes] + left[w]) - f(size_l[:classes]) + f(size_r[:classes] + right[w]) - f(size_r[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            table[b] += after
            table[:, b] += before
            table[b, b] += loop
            size_l[b] += left[w]
            size_r[b] += right[w]
        if not moved:
            break
    return of


def moves(table: np.ndarray, starts: np.ndarray, keys: np.ndarray, n: np.ndarray, own: np.ndarray, marks: np.ndarray, turn: int) -> np.ndarray:
    """The best class of each word, all others held fixed. table: counts of class bigrams, the last class is the end's.

    A word's entries begin at its start; an entry's key is the class after it, or the size of the table and the class
    before it; n tells how often. own: the classes now, -1 if none. marks: crc32 of the words. A word that no class suits
    better than others goes by its mark; one that has a class moves only in every other turn.
    """
    size = len(table)
    classes = size - 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    base = np.concatenate([table[:classes].T, table[:, :classes]])  # by key, then class
    was = f(base)
    one = f(base + 1) - was
    n = n.astype(float)
    ends = np.append(starts[1:], len(keys))
    rows, cols = table.sum(1)[:classes], table.sum(0)[:classes]
    out = np.empty(len(starts), dtype=np.int64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 8_192, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        k, m, mine = keys[a:b], n[a:b], own[at:to]
        gain = one[k]
        if len(many := np.flatnonzero(m != 1)):
            gain[many] = f(base[k[many]] + m[many, None]) - was[k[many]]
        of = np.repeat(mine, ends[at:to] - starts[at:to])
        has = np.flatnonzero(of >= 0)  # in its own class it is counted already
        x = base[k[has], of[has]]
        gain[has, of[has]] = f(x) - f(np.maximum(x - m[has], 0))
        first = starts[at:to] - a
        total = np.add.reduceat(gain, first, axis=0)
        after = np.add.reduceat(np.where(k < size, m, 0.0), first)
        before = np.add.reduceat(np.where(k < size, 0.0, m), first)
        for whole, part in ((rows, after), (cols, before)):
            few, which = np.unique(part, return_inverse=True)
            loss = (f(whole[None, :] + few[:, None]) - f(whole)[None, :])[which]
            has = np.flatnonzero(mine >= 0)
            x = whole[mine[has]]
            loss[has, mine[has]] = f(x) - f(np.maximum(x - part[has], 0))
            total -= loss
        lines = np.arange(to - at)
        best = total.argmax(1)
        best = np.where(total[lines, best] - total.min(1) < 1e-9, marks[at:to] % classes, best)
        stays = (mine >= 0) & ((total[lines, best] <= total[lines, np.maximum(mine, 0)] + 1e-9) | (marks[at:to] // 64 % 2 != turn % 2))
        out[at:to] = np.where(stays, mine, best)
        at = to
    return out


def likelihood(table: np.ndarray) -> float:
    """The part of the training likelihood that classes change."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(table) - f(table.sum(0)) - f(table.sum(1))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers of width bytes, the first bytes of all, then the second, and so on: small ones compress to a byte."""
    return np.ascontiguousarray(x, dtype=f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(x: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel()


def _packed(x: np.ndarray, cuts: np.ndarray, kind: str) -> pa.Array:
    """Rows of numbers as binary: from each cut to the next."""
    x = np.ascontiguousarray(x, dtype=kind)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((np.asarray(cuts) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _unpacked(rows: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of _packed(), one after another, and the cuts."""
    width = np.dtype(kind).itemsize
    if not len(rows):
        return np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)
    _, ends, data = (rows := rows.cast(pa.binary())).buffers()
    at = np.frombuffer(ends, dtype=np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, dtype=np.uint8)
    return whole.view(kind), (at - at[0]) // width


def encoded_slices(given: DataFrame, words: list[bytes], slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Rows of some slice_tokens tokens each, of whole texts that are all held out or all not: slice, held_out, ids, sizes
    (tokens of each text), codes (by _planes; an end before the first text and after each), kinds (a byte for each of
    tails: its tail class), tails (with a space between; no word has one).

    A hot word's code is its rank, the end's their number, another word's n_hot + 1 and its place in tails, where every
    such word of the slice is once: what meets tails later grows with slices, not with a word's frequency.
    """
    spark = given.sparkSession
    sent = spark.sparkContext.broadcast(words)
    id_type = given.schema["id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ranks = {w: i for i, w in enumerate(sent.value)}
        end = len(ranks)
        open_slices: dict[bool, tuple[list, list, list, dict[bytes, int]]] = {}
        made, kind = 0, to_arrow_type(id_type)

        def out(held: bool) -> pa.RecordBatch:
            nonlocal made
            ids, sizes, codes, tails = open_slices.pop(held)
            whole = np.concatenate([np.array([end], dtype=np.int32), *codes])
            made += 1
            ids = pa.concat_arrays(ids)
            listed = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(np.concatenate(sizes)))]
            values = [[made - 1], [held], [_planes(whole, 4)], [bytes(map(_tail, tails))], [b" ".join(tails)]]
            first, held_out, *rest = [pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()])]
            return pa.RecordBatch.from_arrays([first, held_out, *listed, *rest], names=["slice", "held_out", "ids", "sizes", "codes", "kinds", "tails"])

        size = {False: 0, True: 0}
        for chunk in _chunks(batches, 2):
            for held in (False, True):
                part = chunk.filter(pc.equal(chunk.column(1), held))
                if not part.num_rows:
                    continue
                found, sizes = _words(part.column(2))
                found = found.dictionary_encode()
                names = _named(found.dictionary)
                rank = np.array([ranks.get(w, -1) for w in names], dtype=np.int32)
                index = found.indices.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)  # of the texts' words
                done = ends + np.arange(1, len(ends) + 1)  # with an end after each
                at = 0
                while at < part.num_rows:
                    before = int(done[at - 1]) if at else 0
                    to = min(part.num_rows, int(np.searchsorted(done, before + slice_tokens - size[held], "left")) + 1)
                    ids, lengths, kept, tails = open_slices.setdefault(held, ([], [], [], {}))
                    mine = index[int(ends[at - 1]) if at else 0 : int(ends[to - 1])]
                    codes = rank[mine]
                    if len(rare := np.flatnonzero(codes < 0)):
                        each, of = np.unique(mine[rare], return_inverse=True)
                        codes[rare] = np.array([end + 1 + tails.setdefault(names[k], len(tails)) for k in each.tolist()], dtype=np.int32)[of]
                    whole = np.full(int(done[to - 1]) - before, end, dtype=np.int32)
                    is_word = np.ones(len(whole), dtype=bool)
                    is_word[done[at:to] - before - 1] = False
                    whole[is_word] = codes
                    ids.append(part.column(0).slice(at, to - at).cast(kind))
                    lengths.append(sizes[at:to] + 1)
                    kept.append(whole)
                    size[held] += len(whole)
                    if size[held] >= slice_tokens:
                        size[held] = 0
                        yield out(held)
                    at = to
        for held in list(open_slices):
            yield out(held)

    shape = f"slice long, held_out boolean, ids array<{id_type.simpleString()}>, sizes array<long>, codes binary, kinds binary, tails binary"
    return given.mapInArrow(encode, shape).withColumn("slice", F.shiftleft(F.spark_partition_id().cast("long"), 36) + F.col("slice"))


def _arrays(batches: Iterator[pa.RecordBatch], n_hot: int, of: np.ndarray, end_class: int, unmet: int = -1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of (codes, kinds, met, ...): its row, codes, their classes, the tail classes and the counts of its rare words. Words that met doesn't hold are of class unmet and count zero."""
    for batch in batches:
        for i in range(batch.num_rows):
            seq = _numbers(batch.column(0)[i].as_buffer(), 4)
            kinds = np.frombuffer(batch.column(1)[i].as_buffer(), dtype=np.uint8).astype(np.int64)
            rare, times = np.full(len(kinds), unmet, dtype=np.int64), np.zeros(len(kinds), dtype=np.int64)
            if len(met := batch.column(2)[i].values):
                k, cls, c = (_unpacked(x, kind)[0] for x, kind in zip(met.flatten(), ("<i4", "<i4", "<i8")))
                rare[k], times[k] = cls, c
            yield batch.slice(i, 1), seq, np.concatenate([of, [end_class], rare])[seq], kinds, times


def _cells(n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])


def _collected(cells: DataFrame, size: int) -> np.ndarray:
    """Sums by cell, of a number of cells that the classes bound."""
    with _lots(cells.sparkSession):
        got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size)
    n[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return n


def transitions(state: DataFrame, of: np.ndarray, once: np.ndarray, tail: np.ndarray, size: int) -> np.ndarray:
    """Counts of class bigrams in training, apart by whether the second word occurs once; such words count again in and out of their tail class."""
    total, n_hot = size + TAILS, len(of)
    sent = state.sparkSession.sparkContext.broadcast((of, once, tail))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, once, tail = sent.value
        n = np.zeros(2 * total * total, dtype=np.int64)
        for _, seq, cls, kinds, times in _arrays(batches, n_hot, of, size - 1):
            new = np.concatenate([once, [False], times == 1])[seq]
            x, y = cls[:-1], cls[1:]
            seen = (x >= 0) & (y >= 0)
            n += np.bincount(((new[1:] * total + x) * total + y)[seen], minlength=len(n))
            if new.any():
                apart = size + np.concatenate([tail, [0], kinds])[seq]
                for a, b, here in ((apart[:-1], y, new[:-1]), (x, apart[1:], new[1:]), (apart[:-1], apart[1:], new[:-1] & new[1:])):
                    at = np.flatnonzero(here & seen)
                    n += np.bincount((new[1:][at] * total + a[at]) * total + b[at], minlength=len(n))
        yield _cells(n)

    cells = state.where("NOT held_out").select("codes", "kinds", "met").mapInArrow(run, "cell int, n long")
    return _collected(cells, 2 * total * total).reshape(2, total, total)


def move_hot(state: DataFrame, of: np.ndarray, table: np.ndarray, marks: np.ndarray, turn: int, ranks: range) -> np.ndarray:
    """The classes of the hot words after those of these ranks have moved. Neighbours' counts are summed in workers, then by block of words and salt, then by block."""
    spark = state.sparkSession
    size, n_hot = len(table), len(of)
    width = 2 * size
    moving = np.zeros(n_hot + 1, dtype=bool)  # of others, moves() would give the class that they have
    moving[ranks] = (of[ranks] < 0) | (marks[ranks] // 64 % 2 == turn % 2)
    sent = spark.sparkContext.broadcast((of, table, marks, moving))

    def packed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        blocks, first = np.unique(keys // (width * _BLOCK), return_index=True)
        cuts = [*first, len(keys)]
        cells, n = (keys % (width * _BLOCK)).astype(np.int32), n.astype(np.int64)
        made = [[_planes(np.diff(cells[a:b], prepend=np.int32(0)), 4) for a, b in zip(cuts, cuts[1:])], [_planes(n[a:b], 8) for a, b in zip(cuts, cuts[1:])]]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary())], names=["block", "cells", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, _, _, moving), kept, held = sent.value, [], 0
        for _, seq, cls, _, _ in _arrays(batches, n_hot, of, size - 1):
            may = moving[np.minimum(seq, n_hot)]
            for w, m, x, side in ((seq[:-1], may[:-1], cls[1:], 0), (seq[1:], may[1:], cls[:-1], size)):
                keep = np.flatnonzero(m & (x >= 0))
                kept.append(w[keep].astype(np.int64) * width + side + x[keep])
                held += len(kept[-1])
            if held > 2_000_000:
                yield packed(*np.unique(np.concatenate(kept), return_counts=True))
                kept, held = [], 0
        if held:
            yield packed(*np.unique(np.concatenate(kept), return_counts=True))

    def summed(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
        n, block = np.zeros(_BLOCK * width, dtype=np.int64), -1
        for part in batches:
            for block, cells, k in zip(*[part.column(x).to_pylist() for x in ("block", "cells", "n")]):
                n[np.cumsum(_numbers(cells, 4))] += _numbers(k, 8)
        return block, n

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = summed(batches)
        at = np.flatnonzero(n)
        yield packed(block * _BLOCK * width + at, n[at])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table, marks, _ = sent.value
        block, n = summed(batches)
        cells = np.flatnonzero(n)
        inner, starts = np.unique(cells // width, return_index=True)
        code = block * _BLOCK + inner
        to = moves(table, starts, cells % width, n[cells], of[code], marks[code], turn)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(to, pa.int32())], names=["code", "cls"])

    source = state.where("NOT held_out").select("codes", "kinds", "met")
    cells = source.mapInArrow(tally, "block int, cells binary, n binary")
    salts = source.rdd.getNumPartitions() // 64
    if salts > 1:  # a block's sums come from every partition: no task reads more than some 64 partitions' of them
        salted = cells.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        cells = salted.groupBy("block", "salt").applyInArrow(merge, "block int, cells binary, n binary")
    with _lots(spark):
        got = cells.groupBy("block").applyInArrow(best, "code int, cls int").toPandas()
    to = of.copy()
    to[ranks] = np.where(of[ranks] < 0, marks[ranks] % (size - 1), of[ranks])  # without a neighbour that has a class
    to[got["code"].to_numpy()] = got["cls"].to_numpy()
    return to


def place_rare(state: DataFrame, of: np.ndarray, table: np.ndarray, buckets: int) -> DataFrame:
    """slice, met: of each word in the slice's tails its place k, cls and count c in training, by _packed(). The class is that at
    which exchange inserts the word, given those of its neighbours; -2, and the count 0, if it isn't in training.

    A worker sums a word's neighbours within a slice. A word goes to one of the buckets, where these sums are summed again
    as they come in: a bucket holds each word once, with the classes on both sides, however frequent it is.
    """
    size, n_hot = len(table), len(of)
    classes, none = size - 1, 2 * size  # none: the key of a neighbour without a class
    width = none + 1
    sent = state.sparkSession.sparkContext.broadcast((of, table))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value[0]
        for row, seq, cls, _, _ in _arrays(batches, n_hot, of, classes):
            words = row.column(3)[0].as_py().split(b" ")
            to = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(to, kind="stable")
            there, first = np.unique(to[order], return_index=True)
            cuts = np.append(first, len(order))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            here = np.flatnonzero(seq > n_hot) if not row.column(5)[0].as_py() else np.zeros(0, dtype=np.int64)
            after, before, word = cls[here + 1], cls[here - 1], place[seq[here] - n_hot - 1] * width
            keys, n = np.unique(np.concatenate([word + np.where(after < 0, none, after), word + np.where(before < 0, none, size + before)]), return_counts=True)
            own = np.searchsorted(keys, cuts * width)
            each = np.bincount(keys // width, minlength=len(order))
            names = [words[k] for k in order.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(there, pa.int64()), pa.array(np.full(len(there), row.column(4)[0].as_py()), pa.int64()), _packed(order, cuts, "<i4"), pa.array([b" ".join(names[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())], pa.binary()),
                    _packed(each, cuts, "<i4"), _packed(keys % width, own, "<i4"), _packed(n, own, "<i4"),
                ],
                names=["bucket", "slice", "k", "words", "each", "keys", "n"],
            )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value[1]
        ids: dict[bytes, int] = {}
        back, cells, n, summed = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            x, y = np.concatenate(cells), np.concatenate(n)
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else order
            return x[starts], np.add.reduceat(y, starts) if len(x) else y

        for part in batches:
            word = np.array([ids.setdefault(w, len(ids)) for w in b" ".join(part.column("words").to_pylist()).split(b" ")], dtype=np.int64)
            each, cuts = _unpacked(part.column("each"), "<i4")
            cells.append(np.repeat(word, each) * width + _unpacked(part.column("keys"), "<i4")[0])
            n.append(_unpacked(part.column("n"), "<i4")[0].astype(np.int64))
            back.append((part.column("slice"), part.column("k"), word.astype(np.int32), cuts))
            if sum(map(len, cells)) > 2 * summed + 1_000_000:
                x, y = sums()
                cells, n, summed = [x], [y], len(x)
        found, m = sums()
        word, key = found // width, found % width
        c = np.bincount(word, weights=m, minlength=len(ids)).astype(np.int64) // 2
        marks = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
        to = np.where(c > 0, marks % classes, -2)
        keep = key < none
        inner, starts = np.unique(word[keep], return_index=True)
        to[inner] = moves(table, starts, key[keep], m[keep], np.full(len(inner), -1), marks[inner], 0)
        for slices, k, word, cuts in back:
            yield pa.RecordBatch.from_arrays([slices, k, _packed(to[word], cuts, "<i4"), _packed(c[word], cuts, "<i8")], names=["slice", "k", "cls", "c"])

    sums = state.where("length(tails) > 0").select("codes", "kinds", "met", "tails", "slice", "held_out").mapInArrow(tally, "bucket long, slice long, k binary, words binary, each binary, keys binary, n binary")
    return sums.groupBy("bucket").applyInArrow(best, "slice long, k binary, cls binary, c binary").groupBy("slice").agg(F.collect_list(F.struct("k", "cls", "c")).alias("met"))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: str | None = None, clustered: int = CLUSTERED, classes: int | None = None, hot: int = HOT, rounds: int = ROUNDS, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.

    Training texts are those not held out: by column held_out (null: not), else by crc32 of the id mod 7 = 2. A null
    text is an empty one: its one token is the end; texts of any length are read whole. With no training text every
    count is zero and either model gives all words the same; then the score is the base score. Rows that repeat count
    each; no rows give no rows. Words of equal frequency rank by their bytes, a word that several classes suit equally
    goes by its crc32. Columns other than the three named are ignored.
    """
    spark = docs.sparkSession
    out = remainder(id_col, 7) == 2 if held_out is None else F.coalesce(F.col(f"`{held_out}`"), F.lit(False))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), out.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    c = _stored(counts(given.where("NOT held_out")), "counts")

    whole = c.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *(F.count(F.when(F.col("c") == k, 1)) for k in (1, 2))).first()
    total, distinct = int(whole[0]), int(whole[1])
    # the largest set of counts that has at most `hot` words: found from how many words share a count
    steps = c.where((F.length("word") <= HOT_BYTES) & (F.col("c") * 20 * hot >= total)).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(hot).collect()
    least, kept = None, 0
    for r in steps:
        if kept + r["n"] > hot:
            break
        kept, least = kept + r["n"], r["c"]
    if least is None:
        words, freq = [], np.zeros(0)
    else:
        rows = sorted(c.where((F.length("word") <= HOT_BYTES) & (F.col("c") >= least) & (F.col("word") != F.lit(bytearray(_END)))).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
        words, freq = [bytes(r["word"]) for r in rows], np.array([r["c"] for r in rows], dtype=float)
    ends = float(total and c.where(F.col("word") == F.lit(bytearray(_END))).first()["c"])
    dropped(c)
    classes = max(CLASSES, math.ceil(distinct ** (1 / 3))) if classes is None else classes
    clustered, n_hot = min(clustered, len(words)), len(words)
    hot_tail = np.array([_tail(w) for w in words], dtype=np.int64)
    hot_mark = np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    encoded = _stored_slices(encoded_slices(given, words, slice_tokens), "encoded")

    # to start with, unit of a token: a seed's rank; seeds + its tail class for any other word; the last for the end
    seeds = min(SEEDS, clustered)
    units = seeds + TAILS + 1
    unit_of = np.concatenate([np.arange(seeds), seeds + hot_tail[seeds:], [units - 1]]).astype(np.int64)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            for codes, kinds in zip(batch.column(0), batch.column(1)):
                tails = seeds + np.frombuffer(kinds.as_buffer(), dtype=np.uint8).astype(np.int64)
                seq = np.concatenate([unit_of, tails])[_numbers(codes.as_buffer(), 4)]
                n += np.bincount(seq[:-1] * units + seq[1:], minlength=units * units)
        yield _cells(n)

    n = _collected(encoded.where("NOT held_out").select("codes", "kinds").mapInArrow(bigrams, "cell int, n long"), units * units).reshape(units, units)
    of, size = exchange(n, seeds, classes), classes + 1
    # classes of hot words are on the driver, of all others in column met; -1: none yet, -2: not in training
    hot_class = np.full(n_hot, -1, dtype=np.int64)
    hot_class[:seeds] = of[:seeds]
    unmet = F.array().cast("array<struct<k:binary,cls:binary,c:binary>>")
    state = encoded.withColumn("met", unmet)

    if total:
        kept = None
        for turn in range(max(1, rounds)):
            table = transitions(state, hot_class, freq == 1, hot_tail, size).sum(0)[:size, :size]
            value = likelihood(table)
            if turn > 1 and value <= kept[0] + 1e-6:  # in the first round words without a class come in
                break
            kept = (value, hot_class, table)
            hot_class = move_hot(state, hot_class, table, hot_mark, turn, range(clustered))
            released(spark)
        else:
            table = transitions(state, hot_class, freq == 1, hot_tail, size).sum(0)[:size, :size]
            if rounds <= 1 or likelihood(table) > kept[0]:
                kept = (None, hot_class, table)
        _, hot_class, table = kept
        rare = encoded.agg(F.coalesce(F.sum(F.length("kinds")), F.lit(0))).first()[0]  # held-out texts' words go there, too
        met = place_rare(state, hot_class, table, 1 + max(min(BUCKETS, rare // 20_000), rare // BUCKET_WORDS))
        if clustered < n_hot:
            hot_class = move_hot(state, hot_class, table, hot_mark, 0, range(clustered, n_hot))
        state = _stored_slices(merged(encoded).join(met, "slice", "left").withColumn("met", F.coalesce("met", unmet)).drop("tails"), "classes")
        dropped(encoded)
        counted = transitions(state, hot_class, freq == 1, hot_tail, size)
    else:
        counted = np.zeros((2, size + TAILS, size + TAILS))
        hot_class = np.zeros(n_hot, dtype=np.int64)
    discount = whole[2] / (whole[2] + 2 * whole[3] + 1)
    shares = counted[0] + counted[1] * np.where(np.arange(size + TAILS) < size, 1 - discount, discount)
    model = _probabilities(shares, np.arange(size + TAILS), classes)

    # emission: a training word's share of its class; any other word's is one of a class that grows by one
    class_size = np.log10(np.maximum((counted[0] + (1 - discount) * counted[1])[:size, :classes].sum(0), 1e-9))
    new_size = np.log10(counted[1][:size, size:].sum(0) + 1)
    base_norm = math.log10(total + distinct + 1)
    numbers = spark.sparkContext.broadcast((hot_class, freq, class_size, new_size, model))
    end_flat, end_known = math.log10(ends + 1) - base_norm, int(ends > 0)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, freq, class_size, new_size, model = numbers.value
        for row, seq, cls, kinds, times in _arrays(batches, n_hot, of, classes, -2):
            times = np.concatenate([freq, [0.0], times])[seq]
            word, new = seq != n_hot, cls == -2
            if new.any():
                cls = np.where(new, size + np.concatenate([np.zeros(n_hot + 1, dtype=np.int64), kinds])[seq], cls)
            flat = np.where(word, np.log10(times + 1) - base_norm, end_flat)
            emit = np.zeros(len(seq))
            emit[new] = -new_size[cls[new] - size]
            old = word & ~new
            emit[old] = np.log10(np.maximum(times[old] - discount * (times[old] == 1), 1e-9)) - class_size[cls[old]]
            emit[1:] += model[cls[:-1], cls[1:]]
            sizes = row.column(5)[0].values.to_numpy()
            starts = np.cumsum(sizes) - sizes
            flat, emit, known = (np.add.reduceat(x[1:], starts) for x in (flat, emit, np.where(word, times > 0, end_known).astype(np.int64)))
            held = pa.array(np.full(len(sizes), row.column(3)[0].as_py()))
            yield pa.RecordBatch.from_arrays([row.column(4)[0].values, held, pa.array(sizes), pa.array(flat), pa.array(emit), pa.array(known)], names=["id", "held_out", "n_tokens", "base_score", "score", "known"])

    id_type = given.schema["id"].dataType.simpleString()
    scored = _stored(state.select("codes", "kinds", "met", "held_out", "ids", "sizes").mapInArrow(scores, f"id {id_type}, held_out boolean, n_tokens long, base_score double, score double, known long"), "scores")
    dropped(state if total else encoded)
    final = F.col("score") if total else F.col("base_score")
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        "base_score", final.alias("score"), F.pow(F.lit(10.0), -final / F.col("n_tokens")).alias("perplexity"),
    )


def _probabilities(n: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """log10 P(class | class before): bigram shares, with the class's own share as prior of weight 20."""
    total = classes + len(n) - int((of < classes).sum())
    table = np.zeros((total, total))
    np.add.at(table, (of[:, None], of[None, :]), n)
    own = table.sum(0) + 0.5
    prior = own / own.sum()
    return np.log10((table + 20 * prior) / (table.sum(1, keepdims=True) + 20))
