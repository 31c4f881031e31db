"""Writes from a stream: each micro-batch is one commit, and the last write of a document wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.sources.store import Store


def upserts(stream: DataFrame, store: Store, index: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write a stream of (id, source, optionally op, routing, seq) to an index.

    seq orders writes of one document within a batch. Without interval what is there is written and the query ends;
    with it a batch begins every interval. The manifest keeps the number of the stream's last batch, the stream being
    known by its checkpoint: a batch that is replayed after its commit is not written again, blank ids or not.
    """
    optional = {"op": F.lit("index"), "routing": F.lit(None).cast("string"), "seq": F.lit(0).cast("long")}
    shaped = stream.withColumns({k: v for k, v in optional.items() if k not in stream.columns})

    def commit(batch: DataFrame, number: int) -> None:
        ops = batch.select("op", F.col("id").cast("string").alias("id"), F.col("routing").cast("string").alias("routing"), F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("_seq"), F.lit(None).cast("string").alias("_error"))
        if not ops.isEmpty():
            store.apply(index, ops, (checkpoint, number))

    writer = shaped.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
