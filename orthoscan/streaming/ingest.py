"""Streaming ingest of vectors: validate, assign a leaf, append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orthoscan.operators.boxes import with_leaf
from orthoscan.operators.ingest import reject_invalid


def stream_points(stream: DataFrame, dims: int, path: str, checkpoint: str, leaves: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """Append the valid points (record_id, features) of a stream to ``path``, by micro-batch.

    With ``leaves`` (node, lo, hi: an index's zone map) every point also gets
    the node that grows least.  Vectors that aren't valid go to the folder
    ``rejected_path(path)``.  A batch that is run again after a failure
    overwrites its own folder, so that no point is stored twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select("record_id", "features").persist()  # read once for both writes
        valid, rejected = reject_invalid(batch, dims)
        rows = valid if leaves is None else with_leaf(valid, leaves)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path(path)}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rejected_path(path: str) -> str:
    """Where a stream that stores its points in ``path`` puts the others."""
    return f"{path.rstrip('/')}-rejected"


def stored_points(spark, path: str) -> DataFrame:
    """What a stream has stored so far."""
    return spark.read.parquet(path).drop("batch").select("record_id", "features", *([F.col("node")] if "node" in spark.read.parquet(path).columns else []))
