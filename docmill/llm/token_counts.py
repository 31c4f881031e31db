"""Token counts of the documents in flat token files, which hold ids and an end-of-document id after each, and no index.

A file is cut into blocks of fixed size, wherever that falls. In each block one vectorised comparison finds the
separators. Documents across blocks are stitched by a prefix scan over the blocks of a file: a running sum of
separators gives the first one's number, a running maximum of the last separator's place tells where it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm import bpe
from docmill.llm._util import written

#: Ids in a block.
BLOCK_IDS = 1 << 20


def files_of(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder that Hadoop names, and the folder's path in it."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else folder)


def write_files(docs: DataFrame, folder: str, vocabulary: str, eod: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each partition's texts as one file of little-endian 16-bit ids (32-bit if eod needs it); a row for each text: file (its name), at (the text's place in it, from 0), id.

    A null text has no tokens but a separator. A file bears its task attempt's number, so a repeated attempt does not
    disturb another's; only files in the result, which is written out, count.
    """
    kind = "<u2" if eod < 1 << 16 else "<u4"
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, task = bpe.vocabulary(vocabulary), TaskContext.get()
        system, root = files_of(folder)
        system.create_dir(root, recursive=True)
        name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0
        out = None
        for batch in batches:
            out = out or system.open_output_stream(f"{root}/{name}")
            for text in batch.column(1):
                out.write(np.append(v.array(text.as_py() or ""), eod).astype(kind).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), batch.column(0)], names=["file", "at", "id"])
            at += n
        if out:
            out.close()

    return written(source.mapInArrow(run, f"file string, at long, id {source.schema['id'].dataType.simpleString()}"), "token-index")


def sizes(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """file (name) and length in bytes of folder's token files, or of those among files."""
    found = spark.read.format("binaryFile").load(f"{folder}/*.bin").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length")
    return found if files is None else found.join(files.select("file").distinct(), "file", "left_semi")


def count(files: DataFrame, folder: str, eod: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, at, start, n_tokens, ended for each document of folder's files (file, length): ids before its separator, and where they start.

    Two separators in a row hold an empty document between them; ids behind the last one are a document with ended
    false; an empty file has none. A length that is no multiple of an id's width is an error.
    """
    kind = np.dtype("<u2" if eod < 1 << 16 else "<u4")
    width = kind.itemsize
    n_blocks = F.ceil(F.col("length") / (block_ids * width)).cast("long")
    blocks = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files_of(folder)
        for batch in batches:
            for name, length, block in zip(*[c.to_pylist() for c in batch.columns]):
                if length % width:
                    raise ValueError(f"{name}: {length} bytes are no whole number of ids")
                with system.open_input_file(f"{root}/{name}") as f:
                    f.seek(block * block_ids * width)
                    ids = np.frombuffer(f.read(block_ids * width), dtype=kind)
                ends = np.flatnonzero(ids == eod) + block * block_ids
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([length // width]), pa.array([block]), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "total", "block", "n", "last", "ends"],
                )

    found = blocks.mapInArrow(run, "file string, total long, block long, n long, last long, ends array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumns({"first": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "before": F.coalesce(F.max("last").over(earlier), F.lit(-1).cast("long")), "end_block": F.col("block") == F.ceil(F.col("total") / block_ids).cast("long") - 1})
    # each end with the one before it; the last block also closes what has no separator
    open_end = F.col("end_block") & (F.coalesce("last", "before") < F.col("total") - 1)
    ends = F.when(open_end, F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    each = placed.select("file", "first", "before", "total", ends.alias("ends")).select("file", "first", "before", "total", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("before")).otherwise(F.try_element_at("ends", F.greatest("k", F.lit(1)))) + 1
    return each.select("file", (F.col("first") + F.col("k")).alias("at"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("total")).alias("ended"))


def document_counts(docs: DataFrame, folder: str, vocabulary: str, eod: int, id_col: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """id, n_tokens, start for each row of docs: its texts go to flat files in folder, which are then scanned.

    The counts are written out, so that nothing reads folder any more. A null or empty text counts 0; equal texts and
    repeated rows count each, texts of any length whole; other columns are ignored; no rows give no rows.
    """
    index = write_files(docs, folder, vocabulary, eod, id_col, text)
    spark = docs.sparkSession
    if index.isEmpty():
        return index.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start"))
    found = written(count(sizes(spark, folder, index), folder, eod, block_ids), "token-counts")
    # both sides have a row for each text; what their files' size suggests must not make Spark broadcast one
    return index.join(found.hint("merge"), ["file", "at"], "left").select(F.col("id").alias(id_col), "n_tokens", "start")
