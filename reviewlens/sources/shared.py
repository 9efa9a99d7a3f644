"""The folder that the driver and all executors share, for what a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/reviewlens-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than there are cores, as one small file has; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
