"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at once; texts are much longer than rows, so this stays small.
SLICE_ROWS = 256
#: Spark deletes the files of a query's shuffles when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder of this machine serves a local master; on a cluster it is an error, as no
    other machine could read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="kinspark-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there, and its shuffles' files go."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def made_of(df: DataFrame, *parts: DataFrame) -> DataFrame:
    """``df``, with a note of the stored frames that only it reads, for :func:`forget`."""
    df.parts = parts
    return df


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`stored`, and of those that they were made of, once nothing reads them."""
    for df in frames:
        if (at := getattr(df, "stored_at", None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        forget(*getattr(df, "parts", ()))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns (also with clashing names elsewhere) don't matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """Consecutive short pieces of a record batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_slices(batch: pa.RecordBatch, column: int, rows: int = 4096, most_bytes: int = 16 << 20):
    """Consecutive pieces of a record batch of at most ``rows`` rows whose texts have at most ``most_bytes``, or one text that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right"))), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def to_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from sequences or arrays by column name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
