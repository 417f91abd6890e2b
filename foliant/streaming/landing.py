"""Filings that arrive in a folder, segmented batch by batch.

The work is stateless: each micro-batch runs the batch plan and appends its envelopes. File
tracking, retries and exactly-once hand-over of files are Structured Streaming's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.plans.segmentation import envelopes
from foliant.sources.submissions import decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """doc_id (path), content, length of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.col("path").alias("doc_id"), "content", "length")


def segment_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends an envelope row a file to ``out``; a batch that is run again replaces its own rows.

    once: what is there now, then stop; else keep on.
    """

    def write(batch: DataFrame, number: int) -> None:
        envelopes(decode(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arrivals(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
