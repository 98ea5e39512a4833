"""Incremental assignment of new label features to a library with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqlab.operators.cluster import assign, flag_new


def assign_stream(points: DataFrame, centroids: DataFrame, *, threshold: float = 0.65) -> DataFrame:
    """A stream of (id, features) with its nearest cluster, distance and cluster_candidate. Stateless: each row is its own."""
    return flag_new(assign(points, centroids), threshold=threshold)


def append_to_library(points: DataFrame, centroids: DataFrame, path: str, checkpoint: str, *, threshold: float = 0.65) -> StreamingQuery:
    """Append assigned rows to a Parquet library as they come; a batch that is retried overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        assign_stream(batch, centroids, threshold=threshold).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
