"""Scoring of result parts as they arrive, with Structured Streaming.

The stored parts of a run are files that only grow in number, which is what a file stream reads. Scores are per row,
so the stream keeps no state; the best version over everything seen is a batch query on the scored table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, scores: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Read new parquet parts of ``folder``, add ``scores`` and append to ``out``; restarts continue at the checkpoint."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    writer = scores(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
