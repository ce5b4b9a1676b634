"""Running a stream into tables at paths that the caller names.

The output and the progress of a query live at the caller's path, so a stream
that was stopped goes on from there when it is started again with the same
path. Every sink is a file table, never the driver's memory. ``available_now``
runs serve backfills and tests; for a live stream pass another trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """A parquet table as a stream: one file, a folder of part files, or several files whose names begin with ``name``.

    ``max_files`` bounds each micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/{name}*")


def run_append(stream: DataFrame, path: str, trigger: dict | None = None) -> DataFrame:
    """Run an append-mode query into parquet and return the written table."""
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_update(stream: DataFrame, path: str, keys: list[str], trigger: dict | None = None) -> DataFrame:
    """Run an update-mode aggregate, held in the engine's own state, and return the latest row of each key.

    Each micro-batch writes the changed keys to its own folder and overwrites
    it when repeated after a failure. The reader takes the newest batch per key
    with a partial aggregate.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{path}/progress").trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")
