"""Shared storage for intermediate tables and archives.

Lineage is cut by writing Parquet under the folder named in ``spark.checkpoint.dir``, which
every executor of a cluster can reach, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.staging import BROADCAST_ROWS, scratch, shared_dir, small, stage

__all__ = ["BROADCAST_ROWS", "cut", "drop", "release", "scratch", "shared_dir", "small", "table"]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    return stage(df, name)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(table_: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
        _delete(table_.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, once its results are stored elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
