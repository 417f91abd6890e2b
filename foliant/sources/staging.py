"""Stage tables in the session's shared folder.

A stage that several later steps read is written once as Parquet below ``spark.checkpoint.dir``
and read back, so it is neither recomputed nor lost with an executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, a local session makes one; a cluster must name its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-foliant-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of whole texts that a Python function gets at a time; Spark's own bound is 10,000.
TEXT_ROWS = 128
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written and read back. texts: its Python functions read whole texts, which come in batches of TEXT_ROWS.

    So what a Python worker holds does not grow with the rows of a partition.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_BATCH)
    if texts:
        spark.conf.set(_BATCH, str(TEXT_ROWS))
    try:
        # planned anew, for the plan of ``df`` may hold the bound of an earlier use
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


#: A side is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once its results are stored elsewhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
