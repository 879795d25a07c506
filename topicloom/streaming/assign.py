"""Assign new documents to a stored model as they arrive.

Assignment is a stateless projection against the model's centroids, so it is the
batch operator applied to a streaming DataFrame; no watermark or state is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from topicloom.operators.clustering import assign


def assign_stream(vectors: DataFrame, centers: DataFrame, path: str, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Append (doc_id, topic, score) of a stream of (doc_id, embedding) to Parquet files under ``path``.

    ``checkpoint`` is the folder that lets a restart go on where the last run ended.
    """
    return (
        assign(vectors, centers, metric).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
