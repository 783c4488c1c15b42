"""Where jobs keep the tables that cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder in ``spark.checkpoint.dir``; where that is unset, a local one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def until_the_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where a table is too small to come in as many partitions; others as they are.

    For steps that compute much on each row: a file of one row group is read by one task, whatever follows the scan.
    """
    spark = df.sparkSession
    cores, each = spark.sparkContext.defaultParallelism, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * each else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back; the table lasts as long as the application.

    A table has a plan of its own and a known size; ``checkpoint`` would carry statistics and constraints
    of the whole plan along, which grow without end in loops.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    until_the_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
