"""Near-duplicate documents by SimHash and a pigeonring join.

A fingerprint's 64 bits are a ring of seven boxes. If two fingerprints differ in at most 6 bits, the pigeonring
principle says that some box starts a chain of which every first l boxes differ in at most 6 l / 7 bits together. So
the first box is equal, the first two differ in one bit at most, and so on round the ring. The first ``chain`` boxes
make the join key: one side writes them as they are, the other in each variant within the budget. Longer chains are
then checked one box at a time; the seventh is the full Hamming check.

Equal fingerprints are one node before anything is joined, so a group of copies, however large, costs one row. A longer
chain means more keys to ask for and fewer candidates: it is chosen from the number of nodes and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from docmill.llm._util import annotate, dropped, merged, written

WIDTHS = (9, 9, 9, 9, 9, 9, 10)
STARTS = tuple(sum(WIDTHS[:i]) for i in range(7))
MAX_BITS = 6
#: What it takes to test a candidate, a probe's row through the shuffle being 1.
CANDIDATE = 0.1
#: A fingerprint of more rows than this, or than a ten-thousandth of all if that is more, is hot: at most 10,000 are.
HOT_ROWS = 100_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of lower-cased two-word shingles, as a signed long; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(add, [w + b" " for w in words[:-1]], words[1:]) if len(words) > 1 else words
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
    lanes = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fp (long). A null text has the fingerprint of an empty one, 0."""

    def rows(texts: list) -> Iterator[tuple]:
        for t in texts:
            yield (fingerprint(t),)

    return annotate(docs, [T.StructField("fp", T.LongType())], rows, text)


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _budget(boxes: int) -> int:
    return MAX_BITS * boxes // 7


def _masks(box: int, chain: int) -> list[int]:
    """Each difference of the chain's bits within the budgets, as a mask over them, first box highest."""
    widths = [WIDTHS[(box + k) % 7] for k in range(chain)]
    found = [(0, 0)]  # mask, bits set so far
    for k, w in enumerate(widths):
        found = [((m << w) | sum(1 << b for b in bits), n + r) for m, n in found for r in range(_budget(k + 1) - n + 1) for bits in combinations(range(w), r)]
    return [m for m, _ in found]


def best_chain(nodes: int) -> int:
    """The chain by which that many evenly spread fingerprints are joined with the least work."""

    def work(chain: int) -> float:
        return sum(len(_masks(b, chain)) * (1 + CANDIDATE * nodes / (1 << sum(WIDTHS[(b + k) % 7] for k in range(chain)))) for b in range(7))

    return min((2, 3, 4), key=work)


def _passes(box: int, first: int, x: str) -> str:
    """SQL: the chain that starts at box stays within budget at each length from first on."""
    tests, width = [], 0
    turned = x if not STARTS[box] else f"(shiftleft({x}, {STARTS[box]}) | shiftrightunsigned({x}, {64 - STARTS[box]}))"
    for length in range(1, 8):
        width += WIDTHS[(box + length - 1) % 7]
        if length >= first:
            part = turned if width == 64 else f"shiftrightunsigned({turned}, {64 - width})"
            tests.append(f"bit_count({part}) <= {_budget(length)}")
    return "(" + " AND ".join(tests) + ")"


def links(nodes: DataFrame, chain: int = 2) -> DataFrame:
    """Each unordered pair of nodes (fp long, distinct; n long) at 1 to 6 differing bits, once: a, n_a, b, n_b."""
    spec, probes = [], []
    for box in range(7):
        width = sum(WIDTHS[(box + k) % 7] for k in range(chain))
        spec.append((box, STARTS[box], 64 - width))
        # A pair differs by the same mask seen from either side: only the side whose highest differing bit is set asks.
        probes += [(box, STARTS[box], 64 - width, m, 1 << (m.bit_length() - 1) if m else 0) for m in _masks(box, chain)]
    array = lambda rows, names: F.array(*[F.struct(*[F.lit(v).cast("long" if k > 2 else "int").alias(n) for k, (v, n) in enumerate(zip(r, names))]) for r in rows])
    bits = "shiftrightunsigned(shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn), down)"
    tag = "shiftleft(cast(box as long), 40)"
    index = nodes.select(F.col("fp"), F.col("n"), F.inline(array(spec, ("box", "turn", "down")))).select(F.expr(f"{tag} | {bits}").alias("key"), F.col("fp").alias("b"), F.col("n").alias("n_b"))
    probe = (
        nodes.select(F.col("fp"), F.col("n"), F.inline(array(probes, ("box", "turn", "down", "mask", "top"))))
        .where(f"top = 0 OR ({bits} & top) != 0")
        .select(F.expr(f"{tag} | ({bits} ^ mask)").alias("key"), "box", F.expr("mask = 0").alias("same"), F.col("fp").alias("a"), F.col("n").alias("n_a"))
    )
    found = probe.join(merged(index), "key").where("a != b AND (NOT same OR a < b)")
    # this row's own chain first, box by box; then only the first box of which the whole chain passes keeps the pair
    own = "CASE box " + " ".join(f"WHEN {b} THEN {_passes(b, chain + 1, '(a ^ b)')}" for b in range(7)) + " END"
    first = "CASE " + " ".join(f"WHEN {_passes(b, 1, '(a ^ b)')} THEN {b}" for b in range(7)) + " END"
    return found.where(own).where(f"{first} = box").select("a", "n_a", "b", "n_b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The least node of each node's component (node, root), for nodes on an edge (a, b); star contraction with every round written out."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.col("u").cast("decimal(38,0)") + F.col("v")).alias("s"), F.sum((F.xxhash64("u", "v") % 1000003)).alias("h")).first()
        if seen == tuple(state) or not state[0]:
            done = e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
            done._scratch = e._scratch
            return done
        seen = tuple(state)
        both = e.unionAll(e.select("v", "u"))  # large star: a node's larger neighbours join its least neighbour
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # small star: it and its smaller neighbours join the least
        small = large.join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        before, e = e, written(small.where("u != v").distinct(), "edges")
        dropped(before)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chain: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), n_near, component_id, group (one fingerprint of the component, as its key).

    Null or wordless texts have fingerprint zero and link to each other; rows that repeat count as rows of their own;
    a null id counts as a row and is never a component's least id unless there is no other; no rows give no rows. Whole
    texts are read, however long; columns other than the two named are ignored. Keys that many nodes share are split by
    Spark's skew join, rows of a hot fingerprint by salt. The driver holds the hot fingerprints only, 10,000 at most.
    """
    fps = written(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "text").select("id", "fp"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least")), "nodes")
    pairs = written(links(nodes.select("fp", "n"), chain or best_chain(nodes.count())), "links")
    near = pairs.select(F.col("a").alias("fp"), F.col("n_b").alias("n")).unionAll(pairs.select("b", "n_a")).groupBy("fp").agg(F.sum("n").alias("near"))
    roots = components(pairs)
    joined = nodes.join(merged(near), "fp", "left").join(merged(roots.withColumnRenamed("node", "fp")), "fp", "left")
    joined = written(joined.select("fp", "n", "least", F.coalesce("near", F.lit(0)).alias("near"), "root"), "joined")
    dropped(nodes, pairs, roots)
    linked = joined.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    about = joined.where("root IS NULL").select("fp", "n", F.lit(0).cast("long").alias("near"), F.col("least").alias("component_id"), F.col("fp").alias("root"))
    about = about.unionAll(linked.join(merged(least), "root").select("fp", "n", "near", "component_id", "root"))
    about = about.select("fp", "n", (F.col("n") - 1 + F.col("near")).alias("n_near"), "component_id", "root")
    limit = max(hot_rows, (joined.agg(F.sum("n")).first()[0] or 0) // 10_000)
    parts = lambda n: F.when(n > limit, F.ceil(n / limit).cast("int")).otherwise(F.lit(1))
    hot = joined.where(F.col("n") > limit).select("fp", parts(F.col("n")).alias("parts"))  # 10,000 rows at most
    salted = about.select(F.explode(F.sequence(F.lit(0), parts(F.col("n")) - 1)).alias("salt"), "fp", "n_near", "component_id", "root")
    rows = fps.join(F.broadcast(hot), "fp", "left").select("id", "fp", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("salt"))
    return rows.join(merged(salted), ["fp", "salt"]).select(F.col("id").alias(id_col), _hex("fp").alias("fingerprint"), "n_near", "component_id", _hex("root").alias("group"))
