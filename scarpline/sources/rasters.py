"""Raster layers as cell tables, layer versions and patch / mask pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scarpline.functions.geo import Grid
from scarpline.operators.skew import add_totals, positions

# Fixed value: the mark of corrected layer files.
CORRECTED_MARK = "phase5_1"
_GRID_FIELDS = "min_x double, max_y double, pixel double, width int, height int, nodata double"


def write_raster(cells: DataFrame, grid: Grid, path: str) -> None:
    """Cell table (row, col, value[, layer]) plus one row of grid metadata."""
    spark = cells.sparkSession
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    row = (grid.min_x, grid.max_y, grid.pixel, grid.width, grid.height, grid.nodata)
    spark.createDataFrame([row], _GRID_FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """The cells, and the grid whose size decides the join strategy."""
    meta = spark.read.parquet(f"{path}/grid").first()
    return spark.read.parquet(f"{path}/cells"), Grid(**meta.asDict())


def choose_versions(files: DataFrame) -> DataFrame:
    """One file per layer: corrected files first, then by name."""
    rank = F.struct((~F.contains("file_name", F.lit(CORRECTED_MARK))).alias("original"), F.col("file_name").alias("file_name"))
    best = files.groupBy("layer").agg(F.min(rank).alias("best"))
    return best.select("layer", F.col("best.file_name").alias("file_name"), (~F.col("best.original")).alias("corrected"))


def pair_by_position(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Pair the n-th image with the n-th mask of a split, both sorted by name.

    Unpaired files stay with a NULL partner; a split may have no masks at all.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        placed = positions(df.select("split", "file_name"), [F.col("split"), F.col("file_name")])
        based = add_totals(placed, ["split"], [F.min("position").alias("_first")])
        return based.select("split", (F.col("position") - F.col("_first") + 1).alias("pair_no"), F.col("file_name").alias(name))

    return numbered(images, "image").join(numbered(masks, "mask"), ["split", "pair_no"], "full")


def pairing_report(pairs: DataFrame) -> DataFrame:
    counted = pairs.groupBy("split").agg(F.count("image").alias("images"), F.count("mask").alias("masks"))
    return counted.withColumn("counts_match", F.col("images") == F.col("masks"))
