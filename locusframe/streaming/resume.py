"""Incremental forms: new files are processed once, progress is kept by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new_files(
    spark: SparkSession, source: str, schema: object, transform: Callable[[DataFrame], DataFrame], sink: str, progress: str
) -> StreamingQuery:
    """Apply a row-wise ``transform`` to Parquet files that appear under ``source`` and append the result to ``sink``; ends when all present files are done.

    A restart with the same ``progress`` folder takes up where the last run ended, which is what a list of finished ids is for in a batch job.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
