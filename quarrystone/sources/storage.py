"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder in the warehouse, which all share as well."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a cut lineage that lost executors can't undo.

    The table goes when the driver ends, or sooner by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables whose successors stand; others are left alone."""
    for df in tables:
        path = vars(df).pop("_written", None)
        if path:
            _drop(df.sparkSession, path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which it does only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _drop(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
