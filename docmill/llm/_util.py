"""What the operators share: scratch tables, Arrow annotation, text rules."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}  # by application


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of its own only in local mode without that setting."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (app := spark.sparkContext.applicationId) not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='docmill-')}"
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its file system's scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, name: str, **options: int) -> DataFrame:
    """df as a table in the shared folder, read back: later readers neither recompute it nor depend on executors that wrote it. options: Parquet's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def merged(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting whatever Spark takes its size for: that is the size of files as compressed, however many rows are generated of each, and a table under the threshold by it may be too large for the driver that broadcasts it."""
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more, and lets the session delete shuffles that nothing refers to."""
    for df in tables:
        deleted(df.sparkSession, df._scratch)
    released(tables[0].sparkSession)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a path of scratch_path()."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets the session delete shuffles and broadcasts that nothing refers to. What ended last is found the second time only."""
    for pause in (0.3, 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def annotate(df: DataFrame, fields: Sequence[T.StructField], rows: Callable[..., Iterator[tuple]], *inputs: str) -> DataFrame:
    """df with fields added, computed by rows from the values of the inputs; a column of df named like a field gives way to it.

    rows gets a list of values for each input column and yields one tuple for each row, in order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    n, place = len(kept), {f.name: k for k, f in enumerate(kept)}
    # a text goes to the worker once: an input that stays is read in its column
    more = [c for c in dict.fromkeys(inputs) if c not in place]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"__input{k}") for k, c in enumerate(more)])
    read = [place[c] if c in place else n + more.index(c) for c in inputs]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # small slices: Python copies of a few texts at a time, however long they are
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = zip(*rows(*[part.column(k).to_pylist() for k in read]))
                arrays = part.columns[:n] + [pa.array(v, type=k) for v, (_, k) in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names[:n] + [x for x, _ in kinds])

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
