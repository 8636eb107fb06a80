"""A folder for intermediate tables that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; where none is named, in the warehouse, which must not be the driver's own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    if not named and root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: worked out once, and lost executors only cost what follows."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores if they come of fewer files than there are cores: what follows costs more than the move."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or len(rows.inputFiles()) >= cores else rows.repartition(cores)
