"""What a batch of writes does to a table, decided set-wise: which operations take effect, and the last of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A document's key: ids are unique within a shard only.
KEY = ("_shard", "_id")


def outcomes(ops: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """ops (_shard, _id, _seq, _op, _error) with _status, _result, _effective and _last, given the keys of existing documents.

    Whether a document exists before an operation depends on the one before it alone: it does unless that was a
    delete, for a create that fails leaves it in place as one that succeeds does. So a lag decides, and no group is
    folded. An operation with an error counts for nothing. _last marks the last effective operation of each document:
    one sort of its operations, latest first, gives both.
    """
    valid = F.col("_error").isNull()
    # operations with an error are apart, so that all go through one sort
    late = Window.partitionBy(*KEY, "__bad").orderBy(F.desc("_seq"))
    judged = ops.withColumn("__bad", ~valid).withColumn("__before", F.lead("_op").over(late))
    there = F.lit(False)
    if existing is not None:
        judged = judged.join(existing.select(*KEY, F.lit(True).alias("__there")).distinct(), list(KEY), "left")
        there = F.coalesce("__there", F.lit(False))
    exists = F.when(F.col("__before").isNull(), there).otherwise(F.col("__before") != "delete")
    clash = (F.col("_op") == "create") & exists
    status = F.when(~valid, 400).when(clash, 409).when(F.col("_op") == "create", 201).otherwise(200)
    result = F.when(~valid, F.col("_error")).when(clash, "document already exists").otherwise(F.element_at(F.create_map(*map(F.lit, ("index", "indexed", "create", "created", "delete", "deleted"))), F.col("_op")))
    told = judged.withColumns({"_status": status, "_result": result, "_effective": valid & ~clash})
    effective = F.sum(F.col("_effective").cast("long")).over(late.rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("_last", F.col("_effective") & (effective == 1)).drop("__bad", "__before", "__there")


def latest(ops: DataFrame) -> DataFrame:
    """The last operation of each document."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("_seq"))
    # shuffled before they are sorted, in pieces of the advised size: Spark would sort each piece of a file first, as large as that is
    return ops.repartition(*KEY).withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def merged(base: DataFrame, deltas: DataFrame, several: bool = True) -> DataFrame:
    """base under deltas: what a delta writes or deletes hides the base's row of that document.

    The base has one row for each document, so it is only anti-joined with the deltas' keys, which Spark broadcasts
    if they are measured small, and never sorted or grouped itself. Nor is one delta alone, which has one row, too.
    """
    last = latest(deltas) if several else deltas
    kept = base.join(last.select(*KEY), list(KEY), "left_anti")
    return kept.unionByName(last.where("_op != 'delete'").drop("_op"), allowMissingColumns=True)
