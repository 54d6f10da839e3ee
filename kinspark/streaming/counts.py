"""Group counts and projections over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinspark.operators.groups import NA, labelled


def windowed_sizes(stream: DataFrame, ts: str, label: str, window: str = "1 hour", late: str = "10 minutes", na: str = NA) -> DataFrame:
    """(start, clone, n_cells) per tumbling window; rows later than the watermark are dropped."""
    own = labelled(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), label, na)
    return own.groupBy(F.window(ts, window).alias("w"), F.col(label).alias("clone")).agg(F.count("*").alias("n_cells")).select(F.col("w.start").alias("start"), "clone", "n_cells")


def project_stream(stream: DataFrame, project: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Project each micro-batch of edges with a frozen model and append the rows to Parquet.

    A batch that is repeated after a failure overwrites its own folder, so rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        project(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
