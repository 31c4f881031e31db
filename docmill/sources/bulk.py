"""Bulk requests as newline-delimited JSON: an action line, and for all but deletes a document line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions import columns as C

NAMES = ("index", "create", "delete")
#: Lines are put in order within chunks of up to 2^16 lines of a block, and chunks within their file.
CHUNK, CHUNK_BITS = ("file", "block", "chunk"), 16


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, value of the lines of requests under path, one file each.

    A large file is read by several tasks: block is where a task's piece of it begins, and row increases by one from
    line to line of a block. In another pass over the files rows may be numbered otherwise.
    """
    value = F.when(F.endswith(F.col("value"), F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), value.alias("value"))


def of_strings(spark: SparkSession, bodies: list[str]) -> DataFrame:
    """lines of request bodies given as strings."""
    text = spark.createDataFrame([(f"{i:06d}", b) for i, b in enumerate(bodies)], "file string, body string")
    split = text.select("file", F.posexplode(F.split(F.regexp_replace("body", r"\r?\n$", ""), r"\r?\n")).alias("row", "value"))
    return split.select("file", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row"), "value")


def _specs(v: Column) -> dict[str, Column]:
    return {n: C.field(v, n) for n in NAMES}


def in_chunks(rows: DataFrame) -> DataFrame:
    """lines as far as each chunk alone tells: those that may be actions, with the line after them, and a chunk's ends.

    rank counts a chunk's lines that aren't blank, from 0; of the first line and of the one before the chunk nothing is known here.
    """
    may = F.contains(F.col("value"), F.lit("delete")) | F.contains(F.col("value"), F.lit("\\"))
    spec = _specs(F.col("v"))
    looks_delete = F.coalesce(C.present(spec["delete"]) & ~C.present(spec["index"]) & ~C.present(spec["create"]), F.lit(False))
    marked = rows.withColumn("v", F.when(may, F.try_parse_json("value"))).withColumns({"deletes": looks_delete, "dense": F.trim("value") != "", "chunk": F.shiftright("row", CHUNK_BITS)}).drop("v")
    whole, ordered = Window.partitionBy(*CHUNK), Window.partitionBy(*CHUNK).orderBy("row")
    after = lambda what: F.expr(f"lead(IF(dense, {what}, NULL)) IGNORE NULLS OVER (PARTITION BY {', '.join(CHUNK)} ORDER BY row)")
    ranked = marked.withColumns({
        "rank": F.sum(F.col("dense").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        "next": after("value"), "next_row": after("row"),
        "n": F.count("*").over(whole), "start": F.min("row").over(whole),
    })
    known = ranked.withColumn("deleted", F.max(F.when(F.col("deletes"), F.col("rank"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    document = F.coalesce(F.pmod(F.col("rank") - F.col("deleted") - 1, F.lit(2)) == 1, F.lit(False))
    edge = (F.col("row") == F.col("start")) | (F.col("row") == F.col("start") + F.col("n") - 1)
    return known.where(edge | (F.col("dense") & (~document | F.col("deletes") | F.col("next").isNull())))


def carried(chunks: DataFrame) -> DataFrame:
    """A row for each chunk of in_chunks: what the chunks of its file before and after it tell.

    line0 and rank0 are its first line's place among the file's lines and among those that aren't blank, deleted0 the
    place among the latter of the last delete before it, next0 and next_line0 the first line after it that isn't blank.
    """
    first = F.col("dense") & (F.col("rank") == 0)
    each = chunks.groupBy(*CHUNK).agg(
        F.max("n").alias("n"), F.min("start").alias("start"), (F.max("rank") + 1).alias("n_dense"), F.max(F.when(F.col("deletes"), F.col("rank"))).alias("last"),
        F.max(F.when(first, F.col("value"))).alias("value"), F.max(F.when(first, F.col("row"))).alias("row"),
    )
    # as many rows as chunks
    order = Window.partitionBy("file").orderBy("block", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = lambda what: F.expr(f"lead({what}) IGNORE NULLS OVER (PARTITION BY file ORDER BY block, chunk)")
    placed = each.withColumns({"line0": F.coalesce(F.sum("n").over(before), F.lit(0)), "rank0": F.coalesce(F.sum("n_dense").over(before), F.lit(0))})
    return placed.select(*CHUNK, "line0", "rank0", F.max(F.col("rank0") + F.col("last")).over(before).alias("deleted0"), after("value").alias("next0"), after("line0 + row - start").alias("next_line0"))


def items(chunks: DataFrame, carry: DataFrame, default_index: str | None = None) -> DataFrame:
    """file, item (order of the action line), op, index, id, routing, source, error, torn of each bulk item of lines in chunks.

    After an index or create action comes its document, after a delete the next action. Whatever a line that reads as a
    delete is, an action comes after it; so a line's role follows from how far back the last such line is. Blank lines
    between items count for nothing; one in place of a document makes the item torn and, by whole, the file's whole
    request an error.
    """
    joined = chunks.where("dense").join(carry, list(CHUNK))
    at, last = F.col("rank0") + F.col("rank"), F.coalesce(F.col("rank0") + F.col("deleted"), F.col("deleted0"), F.lit(-1))
    line = lambda row: F.col("line0") + F.col(row) - F.col("start")
    action = joined.where(F.pmod(at - last - 1, F.lit(2)) == 0).select(
        "file", "value", line("row").cast("int").alias("line"), F.coalesce("next", "next0").alias("next"),
        (~F.col("deletes") & F.coalesce(F.coalesce(line("next_row"), F.col("next_line0")) - line("row") > 1, F.lit(False))).alias("torn"),
    )
    spec = _specs(F.col("v"))
    op = F.coalesce(*[F.when(C.present(spec[n]), F.lit(n)) for n in NAMES])
    inner = F.coalesce(*[spec[n] for n in NAMES])
    text = lambda key: C.string(C.field(F.col("inner"), key))
    shaped = action.withColumn("v", F.try_parse_json("value")).withColumns({"op": op, "inner": inner})
    named = shaped.withColumns({"index": F.coalesce(text("_index"), F.lit(default_index).cast("string")), "id": text("_id"), "n_keys": F.size(F.try_variant_get("v", "$", "map<string,variant>"))})
    error = (
        F.when(F.col("op").isNull(), "no action is known by this name")
        .when(F.col("n_keys") != 1, "an action line holds one action")
        .when((F.col("op") == "delete") & F.col("id").isNull(), "delete needs an _id")
        .when((F.col("op") != "delete") & F.col("next").isNull(), "the document is missing")
        .when(F.col("index").isNull(), "the item names no index")
    )
    return named.select(
        "file", F.col("line").alias("item"), "op", "index", F.when(F.trim("id") != "", F.col("id")).alias("id"),
        F.coalesce(text("routing"), text("_routing")).alias("routing"), F.when(F.col("op") != "delete", F.col("next")).alias("source"), error.alias("error"), "torn",
    )


def whole(items: DataFrame) -> DataFrame:
    """items with every item of a file that has a torn one an error."""
    torn = items.where("torn").select("file").distinct()
    if torn.isEmpty():
        return items.drop("torn")
    marked = items.drop("torn").join(torn.withColumn("__torn", F.lit(True)), "file", "left")
    return marked.withColumn("error", F.when(F.col("__torn"), "a blank line stands where a document belongs").otherwise(F.col("error"))).drop("__torn")
