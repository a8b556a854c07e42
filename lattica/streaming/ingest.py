"""Edges that arrive over time, kept as a matrix in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_edges(edges: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of (i, j, v) to path, each micro-batch reduced to one row per edge.

    A batch that is replayed after a failure overwrites its own folder, so sums are exact.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("i", "j").agg(F.sum("v").alias("v")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = edges.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark, path: str) -> DataFrame:
    """(i, j, v) with all batches summed."""
    return spark.read.parquet(path).groupBy("i", "j").agg(F.sum("v").alias("v"))
