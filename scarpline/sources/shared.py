"""Intermediate tables in the folder all executors can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder of the cluster.

    The folder is the one the session names in ``spark.checkpoint.dir``, else
    the checkpoint folder set on the context, else the warehouse; executors
    share each of them.
    """
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get(SETTING, None) or (chosen.get() if chosen.isDefined() else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{root.rstrip('/')}/scarpline/{purpose}-{uuid.uuid4().hex}"


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write once and read back: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        target = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(path))
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
