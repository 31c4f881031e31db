"""Nearest neighbours over randomly rotated one-bit codes.

A vector, less the centre of its cell, is normed and turned by a random rotation; its code keeps one sign bit for each
dimension, packed, and two numbers: the length and the inner product of the unit vector with its own code. From the
bits alone the inner product with a query is estimated, with an error bound that shrinks as the root of the
dimensions. A row is only compared exactly if the bound allows it to be nearer than the k-th found so far.

Rows lie in cells, each row in that of the nearest centre, and are stored by cell. A query is answered in its own cell
first. The k-th distance there is the limit for all others: a cell is read for a query only if its border, or the shell
that its rows lie in, comes as near as that, which no row of a cell passed over can. So cells save work where vectors
gather and change no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm._util import dropped, scratch_path, written

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 4.0
#: Numbers of query vectors that one pass over the table holds in each worker.
BLOCK_NUMBERS = 4_000_000
#: Rows at most of which the cells' centres are made; any centres are right, near ones make the bounds tighter.
CENTRE_ROWS = 10_000
#: Cells at most, rows of a cell at least on the average, and rows of a cell, about, in one file.
MAX_CELLS, CELL_ROWS, PART_ROWS = 1024, 5_000, 1_000_000


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has finite components only: id, v (array<double>)."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("v").isNotNull() & F.col("id").isNotNull() & good & F.exists("v", lambda x: x != 0))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (row x words of 64), lengths from the centre, and the unit vectors' inner products with their codes."""
    r = (x - centre) @ turn
    size = np.linalg.norm(r, axis=1)
    own = np.abs(r).sum(1) / (np.sqrt(x.shape[1]) * np.where(size > 0, size, 1))
    bits = np.zeros((len(x), -(-x.shape[1] // 64) * 64), dtype=bool)
    bits[:, : x.shape[1]] = r > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), size, np.where(size > 0, own, 1.0)


def estimates(codes: np.ndarray, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of the coded unit vectors with the turned unit vector q, quantised to 4 bits, and their bounds."""
    dim = len(q)
    low, step = q.min(), max((q.max() - q.min()) / 15, 1e-300)
    level = np.rint((q - low) / step).astype(np.int64)
    sums = np.zeros(len(codes), dtype=np.int64)
    for j in range(4):
        plane = np.zeros(codes.shape[1] * 64, dtype=bool)
        plane[:dim] = (level >> j) & 1
        words = np.packbits(plane, bitorder="little").view(np.uint64)
        sums += np.bitwise_count(codes & words).sum(1, dtype=np.int64) << j
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    inner = (2 * step * sums + 2 * low * ones - step * level.sum() - low * dim) / np.sqrt(dim)
    rounding = step * np.sqrt(dim) / 2 / np.sqrt(dim) * 1.0
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - own**2) / max(1, dim - 1)) / own + EPSILON * rounding / own / np.sqrt(3)
    return inner / own, bound


def centres(sample: np.ndarray, n: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """n centres at most of the sample's vectors by Lloyd's rounds, in the order of their longest spread."""
    distinct = np.unique(sample, axis=0)
    n = max(1, min(n, len(distinct)))
    if n == 1:
        return sample.mean(0, keepdims=True)
    found = distinct[np.random.default_rng(seed).choice(len(distinct), n, replace=False)]
    for _ in range(rounds):
        of = nearest_centre(sample, found)[0]
        size = np.bincount(of, minlength=n)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    spread = np.linalg.svd(found - found.mean(0), full_matrices=False)[2][0]
    return found[np.argsort(found @ spread)]


def nearest_centre(x: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    of, far = [], []
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        d = (part**2).sum(1)[:, None] + (found**2).sum(1) - 2 * part @ found.T
        of.append(d.argmin(1))
        far.append(np.sqrt(np.maximum(0, ((part - found[of[-1]]) ** 2).sum(1))))
    return (np.concatenate(of), np.concatenate(far)) if of else (np.zeros(0, dtype=int), np.zeros(0))


def least_distances(qs: np.ndarray, found: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """How near to each query a row of each cell can be, by the plane between the query's own cell and that one, and by
    the shell around its centre, from inner to outer, that its rows lie in. Query x cell."""
    d2 = np.maximum(0, (qs**2).sum(1)[:, None] + (found**2).sum(1) - 2 * qs @ found.T)
    home = d2.argmin(1)
    between = np.sqrt(((found[home][:, None, :] - found[None]) ** 2).sum(2)) if len(qs) * found.size < 20_000_000 else np.stack([np.sqrt(((found[h] - found) ** 2).sum(1)) for h in home])
    plane = (d2 - d2[np.arange(len(qs)), home][:, None]) / (2 * np.where(between > 0, between, np.inf))
    d = np.sqrt(d2)
    least = np.maximum(np.maximum(plane, d - outer), inner - d)
    return least - 1e-6 * (1 + d + outer)  # what rounding may have added


def _nearest(x: np.ndarray, ids: np.ndarray, coded: tuple, q: np.ndarray, q_id: int, centre: np.ndarray, turn: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x nearest to q within limit, and their distances; q's own row takes no part."""
    codes, size, own = coded
    r = (q - centre) @ turn
    length = np.linalg.norm(r)
    est, bound = estimates(codes, own, r / length if length else r)
    least = np.sqrt(np.maximum(0, size**2 + length**2 - 2 * size * length * np.minimum(1, est + bound)))
    least[ids == q_id] = np.inf
    within = np.flatnonzero(least <= limit) if limit < np.inf else np.flatnonzero(ids != q_id)
    if not len(within):
        return np.zeros(0, dtype=int), np.zeros(0)
    if len(within) > 4 * k:
        guess = within[np.argpartition(least[within], 4 * k - 1)[: 4 * k]]
        limit = min(limit, np.sort(np.sqrt(((x[guess] - q) ** 2).sum(1)))[k - 1])
        within = within[least[within] <= limit]  # every row that the bound leaves a chance
    d = np.sqrt(((x[within] - q) ** 2).sum(1))
    first = np.lexsort((ids[within], d))[:k]
    first = first[d[first] <= limit]
    return within[first], d[first]


_SHAPE = "query int, query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _placed(rows: DataFrame, found: np.ndarray, dim: int) -> DataFrame:
    """rows (id, v) with the number of the nearest centre and the distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = nearest_centre(batch.column(1).flatten().to_numpy().reshape(-1, dim), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(cell.astype(np.int32))], names=["id", "v", "far", "cell"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, far double, cell int")


def _pass(stored: DataFrame, block: tuple, reach: list[np.ndarray], limits: np.ndarray, found: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """What the cells that are reached hold for each query (numbers, ids, vectors) within its limit: k rows of a batch at most."""
    sent = stored.sparkSession.sparkContext.broadcast((*block, reach, limits, found, turn))
    dim = found.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q_ids, qs, reach, limits, found, turn = sent.value
        limits = limits.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            every, vectors, cells = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, dim), batch.column(2).to_numpy()
            out: list[list] = [[], [], [], []]
            for c in np.unique(cells):
                mine = cells == c
                x, ids = vectors[mine], every[mine]
                coded = encode(x, found[c], turn)
                for j in reach[c]:
                    at, d = _nearest(x, ids, coded, qs[j], q_ids[j], found[c], turn, k, limits[j])
                    if len(d) == k:
                        limits[j] = min(limits[j], d[-1])
                    out[0].append(np.full(len(at), numbers[j]))
                    out[1].append(np.full(len(at), q_ids[j]))
                    out[2].append(ids[at])
                    out[3].append(d)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["query", "query_id", "vec_id", "score"])

    cells = [c for c, js in enumerate(reach) if len(js)]
    return stored.where(F.col("cell").isin(cells)).select("id", "v", "cell").mapInArrow(run, _SHAPE)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", block_numbers: int = BLOCK_NUMBERS, cells: int | None = None) -> DataFrame:
    """The k nearest rows of vectors to each row of queries, except rows with the query's id: query_id, rank, vec_id, score.

    Distances are Euclidean, in double precision, nearest first, ties to the smaller id; fewer than k rows are all
    returned. Null, empty or zero vectors, or ones with a null or non-finite component, take no part, nor do rows
    without an id or, as rows, of another dimension than the query. Rows that repeat an id count each; a query repeated
    exactly is answered once. Queries that repeat an id with other vectors are answered each: their id then has up to k
    rows, of ranks from 1, for each vector. Empty tables give no rows; columns other than the two named are ignored.

    Queries go round in blocks of bounded size, by cell; a block's passes read the cells that its queries reach, and
    keep k rows for each query and batch. A cell of many rows is split over files by the hash of their ids.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vector)
    asked = usable(queries, id_col, vector).distinct()
    sizes = asked.groupBy(F.size("v").alias("d")).count().join(base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows")), "d")
    results, before = [], 0  # queries numbered before a block's own
    for dim, _, n in sorted(tuple(r) for r in sizes.collect()):
        rows, mine = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
        # a collected limit reads as many partitions as it needs, and shuffles none
        sample = np.array([r["v"] for r in rows.select("v").limit(max(1, min(CENTRE_ROWS, BLOCK_NUMBERS // dim // 4))).collect()])
        wanted = cells or max(1, min(MAX_CELLS, len(sample) // 8, n // CELL_ROWS, math.ceil(math.sqrt(n) / 8)))
        found, turn = centres(sample, wanted), rotation(dim)
        if len(found) == 1:
            stored, shells = rows.withColumn("cell", F.lit(0)), None
            homes = mine.withColumn("cell", F.lit(0))
        else:
            path = scratch_path(spark, "cells")
            parts = max(1, n // PART_ROWS)
            placed = _placed(rows, found, dim).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
            placed.repartition("cell", "part").drop("part").write.partitionBy("cell").parquet(path)
            stored = spark.read.schema("id long, v array<double>, far double, cell int").parquet(path)
            stored._scratch = path
            shells = np.full((2, len(found)), np.nan)  # a cell without rows is never reached
            for r in stored.groupBy("cell").agg(F.min("far").alias("a"), F.max("far").alias("b")).collect():
                shells[:, r["cell"]] = r["a"], r["b"]
            homes = written(_placed(mine, found, dim), "queries")
        for chosen in _blocks(homes, max(1, block_numbers // dim)):
            got = homes.where(chosen).toPandas()
            numbers, before = np.arange(before, before + len(got), dtype=np.int32), before + len(got)
            block = numbers, got["id"].to_numpy(dtype=np.int64), np.array(got["v"].tolist(), dtype=np.float64).reshape(-1, dim)
            home = got["cell"].to_numpy(dtype=np.int64)
            limits = np.full(len(got), np.inf)
            near = written(_top(_pass(stored, block, [np.flatnonzero(home == c) for c in range(len(found))], limits, found, turn, k), k), "near")
            if shells is not None:
                full = near.groupBy("query").agg(F.max("score").alias("far"), F.count("*").alias("n")).where(F.col("n") >= k).toPandas()
                limits[full["query"].to_numpy(dtype=np.int64) - (numbers[0] if len(numbers) else 0)] = full["far"].to_numpy()
                least = least_distances(block[2], found, *shells)
                least[np.arange(len(home)), home] = np.nan  # known
                reach = [np.flatnonzero(least[:, c] <= limits) for c in range(len(found))]
                if any(map(len, reach)):
                    more = _pass(stored, block, reach, limits, found, turn, k)
                    home_only, near = near, written(_top(near.drop("rank").unionAll(more), k), "nearest")
                    dropped(home_only)
            results.append(near)
        if shells is not None:
            dropped(stored, homes)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = results[0]
    for r in results[1:]:
        every = every.unionAll(r)
    return every.select("query_id", "rank", "vec_id", "score")


def _blocks(homes: DataFrame, size: int) -> list[Column]:
    """Conditions that cut queries into blocks of about size at most: neighbouring cells together, one of many queries by the hash."""
    out: list[Column] = []
    open_cells: list[int] = []
    held = 0
    for cell, n in sorted(tuple(r) for r in homes.groupBy("cell").count().collect()):
        if n > size:
            pieces = -(-n // size)
            out += [(F.col("cell") == cell) & (F.pmod(F.xxhash64("id", "v"), F.lit(pieces)) == j) for j in range(pieces)]
            continue
        if held + n > size:
            out.append(F.col("cell").isin(open_cells))
            open_cells, held = [], 0
        open_cells.append(cell)
        held += n
    return [*out, F.col("cell").isin(open_cells)] if open_cells else out
